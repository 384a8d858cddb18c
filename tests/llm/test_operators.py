"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timbrel.llm import common, components, exact_dedup, jpeg, license_scan, media, mixing, ngram_join, packing, quality, tokens, toxicity, url_filter, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, rid int"
LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(6000))
TEXTS = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, ""), (4, None), (5, LONG), (6, LONG), (7, LONG + "x"), (8, "Alpha  BETA gamma\tdelta epsilon zeta"), (9, "one"), (None, "one"), (10, "Released under the MIT License. more"), (11, "naïve — 日本 x")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", 0, 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(docs, block_bytes=64).collect()
    assert len(got) == len(TEXTS) and sum(r["kept"] for r in got) == len(groups)
    known = dict(TEXTS)
    for r in got:
        text = (known[r["doc_id"]] if r["doc_id"] else "one") or ""
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (max(x for x in groups[text] if x), len(groups[text]), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_classes(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "star"), [(4, 85, 512), (5, 80, 512), (5, 80, 2)])
def test_ngram_join_against_all_pairs(spark, monkeypatch, k, num, star):
    monkeypatch.setattr(ngram_join, "STAR", star)  # larger stars go through differences
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in TEXTS if i]
    for c in range(12):
        first = [f"w{x}" for x in rng.integers(0, 400, rng.integers(3, 90))]
        for _ in range(14):
            copy = list(first)
            for at in rng.integers(0, len(copy), rng.integers(0, 5)):
                copy[at] = f"v{rng.integers(50)}"
            rows.append((len(rows) + 100, " ".join(copy)))
    got = ngram_join.similar_classes(table(spark, rows), k, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows, k, num, 100)


def test_ngram_join_counts_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 5)
    monkeypatch.setattr(ngram_join, "CELLS", 2000)
    rng = np.random.default_rng(6)
    rows = [(i, t) for i, t in TEXTS if i]
    for c in range(3):
        first = [f"{c}w{x}" for x in range(60 + 20 * c)]
        for _ in range(25):
            copy = list(first)
            copy[rng.integers(len(copy))] = f"v{rng.integers(9)}"
            rows.append((len(rows) + 100, " ".join(copy)))
        rows += [(len(rows) + 1000 + i, " ".join(first)) for i in range(4)]
    sets = {i: {tuple(words(t)[j : j + 4]) for j in range(max(1, len(words(t)) - 3))} - {()} for i, t in rows}
    similar = lambda x, y: bool(x & y) and 100 * len(x & y) >= 85 * len(x | y)
    links = {i: sum(similar(x, y) for j, y in sets.items() if j != i) for i, x in sets.items()}
    got = {r["doc_id"]: r["links"] for r in ngram_join.similar_classes(table(spark, rows), 4, 85, 100).collect()}
    assert got == links and max(links.values()) > 20


def test_ngram_join_edges(docs, empty):
    got = ngram_join.similar_classes(docs, 4, 85, 100).collect()
    assert len(got) == len(TEXTS) and next(r for r in got if r["doc_id"] is None)["component_id"] is None
    assert ngram_join.similar_classes(empty).count() == 0


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(6, 300))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        gone = int(rng.integers(0, max(1, int(n * 0.15)) + 1))
        other = base[gone:]
        if not gone or 100 * len(other) < 85 * n:
            continue
        a, b = np.sort(base), np.sort(other)
        names, rows = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85, 100)
        assert set(names[rows == 0].tolist()) & set(names[rows == 1].tolist()), (n, gone)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(2)
    clean = [" ".join("".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(40)) for _ in range(120)]
    rows = [(i, t.upper().replace(" ", "!! ") if i % 2 else t) for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i, _ in rows], "doc_id long, quality boolean")
    got = quality.classify(table(spark, rows), labels).filter("held_out").collect()
    assert got and all(r["predicted"] == 1 - r["doc_id"] % 2 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.classify(docs, labels.limit(0)).filter("score = 0.5").count() == len(TEXTS)
    assert quality.classify(empty, labels).count() == 0


def test_the_gradient_of_the_network():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in quality._start(3).items()}
    data, ends = quality._join([bytes(rng.integers(32, 122, n, dtype=np.uint8)) for n in (5, 700, 300)])
    slope = np.array([0.3, -0.7, 0.5])
    _, state = quality._forward(w, data, ends, keep=True)
    grad = quality._backward(w, state, slope)
    for name, at in (("out", (3,)), ("dense", (2, 5)), ("bias", (4,)), ("near", (3, 2)), ("far", (6, 1)), ("embed", (100, 2))):
        sides = []
        for step in (1e-6, -1e-6):
            w[name][at] += step
            sides.append(float(quality._forward(w, data, ends) @ slope))
            w[name][at] -= step
        assert grad[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-4)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_the_automaton_is_edit_distance():
    terms = ["idiot", "trash", "worthless", "scum"]
    auto = toxicity.build(terms, ["lostra"])
    rng = np.random.default_rng(4)
    tried = [*terms, "lostrabc", "lostr"]
    for t in terms * 60:
        w = list(t)
        for _ in range(rng.integers(0, 3)):
            at = int(rng.integers(len(w)))
            w[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("aixt"), rng.integers(0, 2)))
        tried.append("".join(w) or "a")
    found = set(toxicity.hits(auto, *toxicity._join([w.encode() for w in tried]))[0].tolist())
    for i, w in enumerate(tried):
        want = w.startswith("lostra") or any(edit_distance(w, t) <= toxicity.edits(t) for t in terms)
        assert (i in found) == want, w


def test_toxicity(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, "you are an idiot"), (2, 'He said the word "idiot" in the article'), (3, "what a worthles thing you are"), (4, "a fine day"), (5, None)]
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, rows), none).collect()}
    assert [got[i]["predicted"] for i in range(1, 6)] == [1, 0, 1, 0, 0]
    assert (got[2]["hits"], got[2]["quoted"]) == (1, 1)
    assert toxicity.toxicity(docs, none).count() == len(TEXTS) and toxicity.toxicity(empty, none).count() == 0


def test_toxicity_beside_signs_outside_ascii_and_short_terms():
    texts = ["“idiot”", "you idiot…", "idiot—really", "an\u00a0idiot\u00a0here", "„idiot“", "idiot\U0001f600", "café idioté", "naïvetés"]
    auto = toxicity.build(["idiot", "scum"], [])
    data, ends = toxicity._join([t.encode() for t in texts])
    found = list(zip(*(x.tolist() for x in toxicity.hits(auto, data, ends)), strict=True))
    assert [h[0] for h in found] == list(range(6)) and all(data[a:b].tobytes() == b"idiot" for _, a, b, _ in found)
    # A short term's misspelling counts unless it is a word of the sample.
    rows = [(b"they saw a scam today", 0), (b"a fine quiet day", 0), (b"you scum go away", 1), (b"total scum", 1)]
    model = toxicity.fit(rows, 0.5, ["scum"])
    tried = [b"you scvm", b"a scam", b"Scam", b"scum"]
    assert toxicity.score(model, *toxicity._join(tried))[1].tolist() == [1, 0, 0, 1]


def test_url_filter(spark):
    rows = [
        (1, "https://A.example.com/en/x?utm_source=f#t", None),
        (2, "http://www.example.com/en/x", "<p>"),
        (3, "https://z.net/es/1", ""),
        (4, "https://q.org/alias", '<link rel="canonical" href="https://z.net/es/1/">'),
        (5, "https://r.org/alias", "<meta http-equiv='refresh' content='0; url=//q.org/alias'>"),
        (6, "https://s.org/a", '<link rel="canonical" href="https://b.com/ok"><meta http-equiv="refresh" content="0;url=https://z.net/fr/">'),
        (7, None, None),
        (8, "no scheme", None),
        (8, "https://plain.org", None),
    ]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filter.RULES).collect()
    out = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["page_id"] < 8)
    assert [x[3:] for x in out] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow")]
    assert out[0][1:3] == ("a.example.com", "/en/x") and out[6][1:3] == ("", "")
    moved = url_filter.judge(spark.createDataFrame(rows[8:], "page_id long, url string, html string"), url_filter.RULES, spark.createDataFrame([("https://plain.org/", "https://z.net/fr/2")], "source string, target string"))
    assert moved.first()["verdict"] == "block"


def test_url_filter_follows_broken_tags_and_dot_segments(spark):
    rows = [
        (1, "https://a.org/1", '<link\n  rel="canonical"\n  href="https://z.net/es/1">'),
        (2, "https://a.org/2", '<meta\nhttp-equiv="refresh"\ncontent="0; url=https://z.net/fr/2">'),
        (3, "https://z.net/x/y/3", '<link rel="canonical" href="../../es/./3?a=../b">'),
        (4, "https://z.net/x/4", '<link rel="canonical" href="/q/../fr/">'),
        (5, "https://z.net/x/5", '<link rel="canonical" href="../../../es/u/..">'),
        (6, "https://z.net/x/6", '<link rel="canonical" href="../no/./es/">'),
        (7, "https://z.net/es/3?a=../b", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filter.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block"}


def test_license_scan(docs, empty, spark):
    text = "pre " * 9 + license_scan.TEMPLATES["GPL-3.0"] + " post " * 9
    changed = text.replace("WARRANTY", "guarantee", 1)
    got = {r["doc_id"]: r for r in license_scan.scan(table(spark, [(1, text), (2, changed), (3, "released under the mit")])).collect()}
    assert (got[1]["licenses"], got[1]["containments"]) == (["GPL-3.0"], [1.0])
    assert got[2]["licenses"] == ["GPL-3.0"] and 0.8 <= got[2]["containments"][0] < 1 and got[3]["licenses"] == []
    assert [r["doc_id"] for r in license_scan.scan(docs).collect() if r["licenses"]] == [10]
    assert license_scan.scan(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, {"x": "too short"})


@pytest.mark.parametrize(("name", "space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_tokenizer_s_ids(name, space):
    rng = np.random.default_rng(6)
    texts = [t or "" for _, t in TEXTS]
    texts += ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "B", "'s", "é", " ", "1", "!", "ß", "x", "　", "<|endoftext|>", "é"], rng.integers(0, 14))) for _ in range(400)]
    encoder, plain = tokens.Encoder(tokens.vocabulary(name), space), tokens.load(tokens.vocabulary(name))
    for _ in range(2):
        ids, at = encoder.encode(*tokens.byte_texts(tokens.pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_wavelet_queries():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 5), (2048, 50_000), (5000, 6)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = wavelet.Shard(wavelet.write_shard([1, None], [n, 0], ids))
        assert (shard.decode() == ids).all() and shard.doc_ids == [1, None]
        assert [shard.access(i) for i in range(0, n, 97)] == ids[::97].tolist()
        for token in {*ids[:9].tolist(), 3, 70_000}:
            assert shard.count(token, n // 3, n // 2) == (ids[n // 3 : n // 2] == token).sum()
            assert shard.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_wavelet_tokens(docs, empty):
    plain = tokens.load(tokens.vocabulary(wavelet.VOCABULARY))
    got = wavelet.read_shards(wavelet.write_shards(docs, shard_tokens=50)).orderBy("start").collect()
    at, known = 0, dict(TEXTS)
    assert [r["doc_id"] for r in got] == [None, *range(1, 12)]
    for r in got:
        text = "one" if r["doc_id"] is None else known[r["doc_id"]] or ""
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(empty)).count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing(docs, empty):
    got = packing.pack_documents(docs, capacity=64).collect()
    per = {}
    for r in got:
        per.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert len(per) == len(TEXTS) and all(n == 64 for x in per.values() for _, _, n in sorted(x)[:-1])
    assert check_packed(got, 64) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack_documents(empty).count() == 0


def test_places_is_best_fit_decreasing():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 65, 200).tolist(), reverse=True)
        bins = []
        for n in lengths:
            fits = [i for i, g in enumerate(bins) if g >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(64 - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = []
        for length, low, high, each, first, offset in packing.places(counts, 64):
            rows += [{"sequence_id": first + j // each, "offset": offset + j % each * length, "length": length} for j in range(high - low)]
        assert len(rows) == 200 and check_packed(rows, 64) == len(bins)


def test_mixing(spark, docs, empty):
    rows = spark.createDataFrame([(i, "big" if i % 3 else ("b", "c")[i // 3 % 2]) for i in range(3000)], "doc_id long, source string")
    weights = {"big": 0.5, "b": 0.3, "c": 0.2}
    got = [r for r in mixing.mix(rows, weights, block_docs=4, period=100).collect() if r["selected"]]
    order = dict(sorted({r["slot"]: r["source"] for r in got}.items()))
    assert list(order) == list(range(len(order))) and len(order) > 300
    seen = dict.fromkeys(weights, 0)
    for n, source in enumerate(order.values(), 1):
        seen[source] += 1
        assert all(abs(seen[s] - w * n) < 1 for s, w in weights.items())
    out = mixing.mix(docs)
    assert out.count() == len(TEXTS) and out.filter("slot IS NULL").count() == 0
    assert mixing.mix(docs, {"s1": 1.0}).filter("slot IS NULL").count() > 0 and mixing.mix(empty).count() == 0


def test_mixing_holds_to_the_exact_weights(spark):
    # No multiples of 1 / 4096: over many periods rounded weights are off by more than a block; one lies below 1 / 4096.
    counts = {"a": 30011, "b": 20011, "c": 9973, "d": 12}
    weights = {s: n / 7 + 0.123 for s, n in counts.items()}
    total = sum(weights.values())
    rows = spark.range(sum(counts.values())).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id < 30011 THEN 'a' WHEN id < 50022 THEN 'b' WHEN id < 59995 THEN 'c' ELSE 'd' END").alias("source"))
    got = mixing.mix(rows, weights, block_docs=1).filter("selected").select("slot", "source").orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(len(got))) and len(got) > 50_000
    seen = dict.fromkeys(weights, 0)
    for n, r in enumerate(got, 1):
        seen[r["source"]] += 1
        assert all(abs(seen[s] - w * n / total) < 1 for s, w in weights.items())
    out = mixing.mix(rows, block_docs=8).groupBy("slot").agg(F.count_distinct("source", "block").alias("n"), F.count("*").alias("rows")).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out))) and all(r["n"] == 1 and r["rows"] <= 8 for r in out)


def test_mixing_without_weights_keeps_all_documents(spark):
    rows = table(spark, [(i, f"text {i}") for i in range(900)]).withColumn("source", F.expr("CASE WHEN doc_id = 0 THEN 'rare' WHEN doc_id < 9 THEN NULL WHEN doc_id < 90 THEN 'small' ELSE 'hot' END"))
    out = mixing.mix(rows, block_docs=4).collect()
    assert len(out) == 900 and all(r["selected"] and r["slot"] is not None for r in out)
    assert {r["doc_id"] for r in mixing.take_mix(rows).collect()} == set(range(900))
    given = [r for r in mixing.mix(rows, {"hot": 0.5, "small": 0.5}, block_docs=4).collect() if r["selected"]]
    assert 0 < len(given) < 900 and {r["source"] for r in given} == {"hot", "small"}


def test_schedules_meet_their_windows():
    rng = np.random.default_rng(9)
    for _ in range(40):
        slots = {i: int(x) for i, x in enumerate(rng.integers(1, 30, rng.integers(1, 12)))}
        period = sum(slots.values())
        for s, times in mixing.schedule(slots).items():
            assert all(i * period // slots[s] <= t < -(-(i + 1) * period // slots[s]) for i, t in enumerate(times))


def test_media(docs, empty):
    got = media.describe(media.store(docs)).collect()
    known = dict(TEXTS)
    assert len(got) == len(TEXTS)
    for r in got:
        data = ("one" if r["doc_id"] is None else known[r["doc_id"]] or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.describe(media.store(empty)).count() == 0


def test_jpeg_round_trip_and_thumbnail():
    rng = np.random.default_rng(0)
    for share in (0, 0.5, 0.97):
        counts = rng.integers(1, 30, 6)
        blocks = rng.integers(-128, 128, (counts.sum(), 64)).astype(np.int32)
        blocks[rng.random(blocks.shape) < share] = 0
        at = 0
        for image, n in zip(jpeg.read(jpeg.write(blocks, counts, [b""] * 6)), counts, strict=True):
            flat = image.coefficients[0].reshape(-1, 64)
            assert (flat[:n] == blocks[at : at + n]).all() and not flat[n:].any()
            assert (image.thumbnail().reshape(-1)[:n] == np.clip(blocks[at : at + n, 0] + 128, 0, 255)).all()
            at += n
    with pytest.raises(ValueError):
        jpeg.read([b"GIF89a"])


def test_chunks_give_the_tokenizer_s_own_ids():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "a", "B", "Hello", "don't", "'s", "'", "I'LL", "123", ",", "...", "!?", "<|endoftext|>", "é", "É", "ß", "é", "H̱", "日本", "İ", " ", "　", "\u0085", "“", "—", "😀", "²", "_", "x1", "\x1c", "\x00", "ΑΣ", "ǅ", "​", "١٢"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    for name, space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokens.vocabulary(name)
        encoder, whole = tokens.Encoder(path, space), tokens.load(path)
        ids, at = encoder.encode(*common.byte_texts(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [whole.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def _slow_logit(w, text):
    """The classifier's logit, spot by spot."""
    half = quality.HALF
    data = text + bytes(max(2, -(-len(text) // half)) * half - len(text))
    spots = len(data) // quality.HOP
    near = [w["embed"][list(data[4 * i : 4 * i + 4])].reshape(-1) for i in range(spots)]
    response = [near[i] @ w["near"] + (near[i + 1] @ w["far"] if i + 1 < spots else 0) for i in range(spots)]
    units = []
    for at in range(0, len(data) - half, half):
        pooled = np.max(response[at // 4 : (at + 2 * half) // 4], axis=0)
        units.append(np.maximum(np.maximum(pooled + w["bias"], 0) @ w["dense"] + w["offset"], 0))
    return float(np.concatenate([np.max(units, axis=0), np.mean(units, axis=0)]) @ w["out"] + w["level"][0])


def test_classifier_forward_pass_against_a_slow_one():
    rng = random.Random(2)
    texts = [b"", b"a", bytes(rng.randrange(256) for _ in range(128)), b"x" * 129, bytes(rng.randrange(256) for _ in range(70_001))]
    w = quality._start(3)
    got = quality._forward(w, *quality._join(texts))
    assert np.allclose(got, [_slow_logit(w, t) for t in texts], atol=1e-3)


def test_samples_hold_whole_texts_of_any_length(spark):
    from timbrel.llm import labelled

    rows = [(i, "x" * (100_000 if i % 7 == 0 else 10)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(14, 1), (14, 0), (None, 1), (3, None)], "doc_id long, quality int")
    found, share = labelled.sample(docs, marks, "quality", 1000, 1 << 30)
    used = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    want = {i: 1 if i == 14 else i % 2 for i in used}
    assert sorted((len(t), y) for t, y in found) == sorted((len(dict(rows)[i]), y) for i, y in want.items())
    assert share == pytest.approx(sum(want.values()) / len(want))
    few, _ = labelled.sample(docs, marks, "quality", 1000, 250_000)
    assert 0 < sum(len(t) for t, y in few if y == 1) <= 250_000


def test_copies_of_rows_without_an_own_id_go(spark):
    rows = [(1, "same", 5), (1, "same", 5), (2, "other", 6), (None, "null", 1), (None, "null", 2), (None, None, 3), (3, "", 4), (1, "b", 7), (2, "b", 8), (2, "same ", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = exact_dedup.drop_copies(frame)
    assert got.columns == frame.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "same", 5), (2, "other", 6), (None, "null", 1), (3, "", 4), (2, "b", 8), (2, "same ", 9)]))


def test_mixed_rows_are_in_order_of_their_slots(spark):
    names = "node component rank _rank a b members slot place".split()
    rows = [(None if i % 50 == 0 else i // 2 * 2 if i % 30 == 1 else i, "s" if i % 3 else None, *range(i, i + 9)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{n} int" for n in names))
    got = [tuple(r) for r in mixing.take_mix(frame).collect()]
    assert Counter(got) == Counter(rows) and mixing.take_mix(frame).columns == frame.columns
    slots = Counter()
    for r in mixing.mix(frame).collect():
        slots[r["doc_id"], r["source"]] += 1
    assert slots == Counter((r[0], r[1]) for r in rows)
    shares = [sum(r[1] is None for r in got[:at]) / at for at in (200, 300, 400)]
    assert max(shares) - min(shares) < 0.05


def _edited(words, rng, most):
    words = list(words)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"w{rng.randrange(99)}"
        elif kind == 1 and len(words) > 6:
            del words[at]
        else:
            words.insert(at, f"w{rng.randrange(99)}")
    return words


def test_license_scan_against_containment_by_loops(spark):
    rng = random.Random(4)
    split = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    known = {n: split(t) for n, t in license_scan.TEMPLATES.items()}
    texts = []
    for n, own in sorted(known.items()):
        for most in (0, 1, 2, 2, 4, 4, 8):
            before, after = ([f"x{rng.randrange(500)}" for _ in range(rng.randrange(40))] for _ in range(2))
            texts.append(" ".join(before + _edited(own, rng, most) + after))
    texts += ["", "too short", " ".join(f"y{i}" for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        s, want = grams(split(texts[r["doc_id"]])), {}
        for n, own in known.items():
            mine = set(grams(own))
            near = [len(mine & set(s[max(0, i - len(grams(own))) : i + len(grams(own)) + license_scan.WINDOW])) / len(mine) for i in range(len(s)) if s[i] in mine]
            if max(near, default=0) >= 0.8:
                want[n] = max(near)
        assert dict(zip(r["licenses"], r["containments"])) == pytest.approx(want), texts[r["doc_id"]]


def test_url_filter_against_its_sql(spark):
    import duckdb

    rng = random.Random(8)
    hosts = ["a.com", "example.com", "www.example.com", "x.example.com", "b.net", "c.org", "d.org", "E.ORG"]
    paths = ["", "/", "/en/", "/en/x", "/es/y", "/fr/z?utm_a=1&q=2", "/p/q/", "/p/q?gclid=1", "/p/r#frag"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}"
    link = ['<link rel="canonical" href="{}">', "<link\n rel='canonical'\n href='{}'/>", "<LINK HREF={} REL=canonical>", '<meta http-equiv="refresh" content="0; url={}">', "<link rel=stylesheet href={}>"]
    target = lambda: rng.choice([url(), "/es/y", "//b.net/fr/z", "more", "sub/page"])
    rows = [(i, rng.choice([url(), url(), url(), None, "no-scheme", ""]), rng.choice([None, "", "text ".join(rng.choice(link).format(target()) for _ in range(rng.randrange(3)))]), 1, 2) for i in range(150)]
    rows += rows[:3]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node int, component int")
    got = url_filter.judge(pages, url_filter.RULES).toPandas()
    con = duckdb.connect()
    con.register("frame", pages.toPandas())
    con.execute("CREATE VIEW pages AS SELECT page_id, CAST(url AS VARCHAR) AS url, CAST(html AS VARCHAR) AS html FROM frame")
    want = con.execute(url_filter.OP6_SQL).fetchdf()
    as_rows = lambda t: sorted(map(str, t[["page_id", "host", "path", "rule", "verdict"]].where(t.notna(), None).itertuples(index=False, name=None)))
    assert as_rows(got) == as_rows(want) and set(got.verdict) == {"allow", "block"}
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


#: Every letter that a chunk of one piece may hold, and neighbours of it in UTF-8: í is C3 AD, whose AD byte-level BPE does not write as itself.
ODD_LETTERS = ["í", "Día", "país vecinos", "Ílex", " íí í", "aquí.", "a­ b", *(f"x{chr(c)} {chr(c)}" for c in range(0xC0, 0x100)), *(chr(c) for c in range(0x80, 0x180))]


def test_wavelet_tokens_of_each_latin_letter(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary(wavelet.VOCABULARY))
    got = wavelet.read_shards(wavelet.write_shards(table(spark, list(enumerate(ODD_LETTERS))))).orderBy("doc_id").collect()
    at = 0
    for r, text in zip(got, ODD_LETTERS, strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), text
        at += len(ids)


def test_packing_pieces_of_each_latin_letter(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary(packing.VOCABULARY))
    got = packing.pack_documents(table(spark, list(enumerate(ODD_LETTERS))), capacity=4).collect()
    found = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got}
    want = {}
    for i, text in enumerate(ODD_LETTERS):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, n): (at, len(ids[at : at + 4]), zlib.crc32(ids[at : at + 4].tobytes())) for n, at in enumerate(range(0, len(ids), 4))}
    assert found == want and len(got) == len(want)
    check_packed(got, 4)


def test_packing_query_on_odd_rows(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True  # as the vocabularies' README says
    rng = random.Random(7)
    parts = ["The", "don't", "I'LL ", "día", "DÍA ", "é", "İ", "İ", "ς", "≠", "K", "3.14", "…", "日本", " ", "　", "\x85", "\x00", " \n", "<|endoftext|>", "<|startoftext|>", "</w>"]
    rows = list(enumerate([None, "", " \t\n", "x" * 9000, *("the " * n for n in (2046, 2047, 2048, 4095, 4096)), *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300))]))
    rows += [(-1, "below zero"), (2, "an id twice"), (None, "no id"), (None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op9_best_fit_packing(spark, str(tmp_path)).collect()
    want = Counter()
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_packed(got, 2048)


def near_copies(seed, classes=6):
    rng = np.random.default_rng(seed)
    rows = [(i, t) for i, t in TEXTS if i]
    for _ in range(classes):
        first = [f"w{x}" for x in rng.integers(0, 400, rng.integers(20, 70))]
        for _ in range(8):
            copy = list(first)
            for at in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[at] = f"v{rng.integers(50)}"
            rows.append((len(rows) + 100, " ".join(copy)))
    return rows


def test_ngram_join_of_few_rows_writes_few_tables(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR", 2)  # all steps run
    written, path = [], common.scratch_path
    monkeypatch.setattr(common, "scratch_path", lambda session, name: written.append(name) or path(session, name))
    rows = near_copies(8)
    got = ngram_join.similar_classes(table(spark, rows), 4, 85, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows, 4, 85, 100)
    assert "links" in written and len(written) <= 18, written


@pytest.mark.parametrize("most", [1, 40])
def test_ngram_join_of_many_rows_gives_the_same(spark, monkeypatch, most):
    for name in ("FEW", "BROADCAST_IDS"):
        for module in (common, ngram_join):
            monkeypatch.setattr(module, name, most)
    monkeypatch.setattr(ngram_join, "STAR", 6)
    rows = near_copies(9)
    sets = {i: {tuple(words(t)[j : j + 4]) for j in range(max(1, len(words(t)) - 3))} - {()} for i, t in rows}
    similar = lambda x, y: bool(x & y) and 100 * len(x & y) >= 85 * len(x | y)
    got = ngram_join.similar_classes(table(spark, [*rows, rows[3], rows[-1]]), 4, 85, 100).distinct().collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows, 4, 85, 100)
    assert {r["doc_id"]: r["links"] for r in got} == {i: sum(similar(x, y) for j, y in sets.items() if j != i) for i, x in sets.items()}


def test_components_of_few_edges(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(i + 1, i) for i in range(200, 230)] + [(None, 3), (5, 5)]
    edges = spark.createDataFrame(edges, "a long, b long")
    want = {(r["node"], r["component"]) for r in components.components(edges).collect()}
    assert {(r["node"], r["component"]) for r in components.components_of_few(edges).collect()} == want
    assert components.components_of_few(edges.limit(0)).count() == 0


def test_byte_chunks_stay_remembered_and_are_merged_in_short_texts(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 1000)
    path = tokens.vocabulary(wavelet.VOCABULARY)
    encoder, plain, merged = tokens.Encoder(path, True), tokens.load(path), []
    merge = encoder._merged
    monkeypatch.setattr(encoder, "_merged", lambda chunks: merged.append(len(chunks)) or merge(chunks))
    rng = random.Random(4)
    many = list({"".join(rng.choice("abcdeéñ") for _ in range(9)) for _ in range(1500)})[:1400]
    for some in (many[:700], many[700:], many[:50]):
        text = " ".join(["", *some])
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]
    assert merged == [700, 700] and tokens.JOINED <= 256
