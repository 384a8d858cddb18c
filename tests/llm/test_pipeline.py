"""The pipeline and its stages' row filters against brute force: a hot source, one of one document, a null source, copies."""

from collections import Counter

import corpus_pipeline
import pytest

from timbrel.llm import common, packing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the river runs slowly past old houses and people walk along its quiet banks in the evening light"
JUNK = "click buy now $$$ !!! 0000 ||| ### free free free @@@ %%% win win win"


def _text(i):
    return " ".join(f"{w}{i * 31 + at * 7}" for at, w in enumerate((GOOD + " " + GOOD + " " + GOOD).split()))


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): 1-300 distinct, 301-330 copies of 1-3, 331-360 near copies of 4-6, 361-390 junk, and odd ones."""
    out = [(i, _text(i)) for i in range(1, 301)]
    out += [(i, _text(1 + i % 3)) for i in range(301, 331)]
    out += [(i, _text(4 + i % 3) + f" end{i}") for i in range(331, 361)]
    out += [(i, f"{JUNK} {i} " * 5) for i in range(361, 391)]
    out += [(391, ""), (392, None), (393, "one")]
    return [(i, t, "rare" if i == 7 else None if i % 40 == 0 else "small" if i % 10 == 3 else "hot") for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i <= 300), 0) for i, _, _ in rows if i <= 300 or 361 <= i <= 390]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _without_copies(rows):
    keep = {}
    for i, t, s in rows:
        keep[t or ""] = max((keep.get(t or "", (0,)), (i, t, s)), key=lambda r: r[0])
    return list(keep.values())


def _without_near_copies(rows):
    sets = {i: _shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [r for r in rows if top(r[0]) == r[0]]


def _triples(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_stages_and_run_against_brute_force(spark, rows, folder):
    docs, labels = common.documents(spark, folder), common.documents(spark, folder, "labels")
    stages = dict(corpus_pipeline.STAGES)
    scored = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    good = [r for r in rows if scored[r[0]] == 1]
    assert 0 < len(good) < len(rows) == len(scored)
    kept = stages["quality"](spark, docs, folder)
    assert _triples(kept) == Counter(good) and kept.columns == docs.columns
    # Each filter alone on all rows: whatever the classifier says, the groups of copies are there.
    copies = stages["exact dedup"](spark, docs, folder)
    assert _triples(copies) == Counter(_without_copies(rows)) and copies.columns == docs.columns
    near = stages["n-gram Jaccard join"](spark, docs, folder)
    assert _triples(near) == Counter(_without_near_copies(rows)) and near.columns == docs.columns
    mixed = stages["mixing"](spark, docs, folder)
    assert _triples(mixed) == Counter(rows) and mixed.columns == docs.columns
    left = _without_near_copies(_without_copies(good))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in left} and None in {r[2] for r in left} and "rare" in {r[2] for r in left}
    plain = tokens.load(tokens.vocabulary(packing.VOCABULARY))
    sizes, ends = Counter(), Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
        ends[r["sequence_id"]] += r["length"]
        assert 0 <= r["offset"] and r["offset"] + r["length"] <= 2048
    assert max(ends.values()) <= 2048
    assert sizes == {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in left}


def test_packing_follows_the_mix(spark, rows, folder, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = common.documents(spark, folder)
    plain = sorted(sorted((r["offset"], r["length"]) for r in group) for group in _sequences(packing.pack_documents(docs)).values())
    mixed = stages["mixing"](spark, docs, folder)
    order = [r["doc_id"] for r in mixed.collect()]
    written = {}
    for name, df, want in (("mixed", mixed, order), ("reversed", spark.createDataFrame(mixed.collect()[::-1], SCHEMA), order[::-1])):
        # More files than the reader takes in their order: sizes differ.
        df.write.option("maxRecordsPerFile", 50).parquet(f"{tmp_path}/{name}")
        out = stages["best-fit packing"](spark, spark.read.parquet(f"{tmp_path}/{name}"), folder)
        place = {d: i for i, d in enumerate(want)}
        groups = _sequences(out)
        assert sorted(groups) == list(range(len(groups))) and out.columns == packing.pack_documents(docs).columns
        # The same sequences by shape, in the order of their first pieces' documents.
        assert sorted(sorted((r["offset"], r["length"]) for r in group) for group in groups.values()) == plain
        first = [min(groups[s], key=lambda r: r["offset"]) for s in sorted(groups)]
        at = [(place[r["doc_id"]], r["piece"]) for r in first]
        assert at == sorted(at)
        written[name] = [r["doc_id"] for r in first]
    assert written["mixed"] != written["reversed"]
    # Rows that are not of files: in the order of partitions.
    out = stages["best-fit packing"](spark, spark.createDataFrame(mixed.collect(), SCHEMA), folder)
    assert [min(g, key=lambda r: r["offset"])["doc_id"] for _, g in sorted(_sequences(out).items())] == written["mixed"]


def _sequences(packed):
    groups = {}
    for r in packed.collect():
        groups.setdefault(r["sequence_id"], []).append(r)
    return groups
