"""The formats, in order of detection: the first that fits a log is its format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.formats.spec import Format
from timbrel.functions import severity as S

ISO = r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:\s?(?:Z|[+-]\d\d:?\d\d))?)"
SLASH = r"(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d(?:\.\d+)?)"
BSD = r"([A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d)"
CTIME = r"([A-Z][a-z]{2} [A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d(?:\.\d+)? \d{4})"
DMY = r"(\d{1,2}-[A-Z][a-z]{2}-\d{4} \d\d:\d\d:\d\d(?:\.\d+)?)"
CLF_STAMP = r"(\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})"
LEVEL = r"(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|SEVERE|CRITICAL|FATAL|ALERT|EMERG|PANIC)"
CLF = r"^(\S+) (\S+) (\S+) \[" + CLF_STAMP + r'\] "([^"]*)" (\d{3}) (\S+)'


def _status(parts: dict[str, Column]) -> Column:
    return S.http_status(parts["http_status"].try_cast("int"))


def _words(*rules: tuple[list[str], str], default: str = "info"):
    return lambda parts: S.tiers(parts["message"], *rules, default=default)


_BAD, _ODD = ["error", "fail", "fatal", "critical", "panic", "denied", "refused", "unable", "cannot"], ["warn", "timeout", "timed out", "retry", "unreachable", "disconnect", "deprecated", "rejected"]
_KEYWORDS = _words((_BAD, "error"), (_ODD, "warning"))


def _squid(parts: dict[str, Column]) -> Column:
    status = parts["http_status"].try_cast("int")
    return F.when(parts["result_code"].contains("DENIED") | (status == 407), "warning").otherwise(S.http_status(status))


def _blocked(parts: dict[str, Column]) -> Column:
    return F.when(F.lower(parts["action"]).isin("block", "reject", "drop"), "warning").otherwise("info")


def _line(name: str, pattern: str, parts: str, **more) -> Format:
    return Format(name, pattern, tuple(parts.split()), **more)


def _syslog(name: str, tags: str, severity=_KEYWORDS, **more) -> Format:
    """RFC 3164 lines of some programs; they must be half of a sample's syslog lines."""
    return Format(name, rf"^{BSD} (\S+) ((?:{tags})[\w./-]*)(?:\[(\d+)\])?: (.*)$", ("ts", "host", "source", "pid", "message"), time="3164", tag=tags, severity=severity, **more)


def _json(name: str, gate: str, message: str, level: str = "", ts: str = "time timestamp ts", time: str = "iso", levels: dict | None = None, **extra: str) -> Format:
    paths = {"message": tuple(message.split()), "ts": tuple(ts.split()), **({"level": tuple(level.split())} if level else {}), **{k: tuple(v.split()) for k, v in extra.items()}}
    return Format(name, json=paths, gate=gate, time=time, levels=levels or {})


def _has(*keys: str) -> str:
    """A JSON object line with all these keys."""
    return r"^\s*\{" + "".join(rf'(?=.*"{k}"\s*:)' for k in keys)


_LEVEL_NUMBERS = {"10": "debug", "20": "debug", "30": "info", "40": "warning", "50": "error", "60": "critical"}
_SYSLOG_NUMBERS = {"0": "critical", "1": "critical", "2": "critical", "3": "error", "4": "warning", "5": "info", "6": "info", "7": "debug"}
_GO = {"I": "info", "W": "warning", "E": "error", "F": "critical", "D": "debug"}
_JUL = {"SEVERE": "error", "CONFIG": "info", "FINE": "debug", "FINER": "debug", "FINEST": "debug"}
_POSTGRES = {"FATAL": "critical", "PANIC": "critical", "ERROR": "error", "WARNING": "warning", "LOG": "info", "DETAIL": "info", "HINT": "info", "STATEMENT": "info", "CONTEXT": "info"}



def _redis(parts: dict[str, Column]) -> Column:
    bad = S.any_phrase(F.lower(parts["message"]), ["oom", "out of memory", "crashed", "panic", "corruption", "failed", "can't save", "fork", "rdb", "aof error"])
    return F.when(parts["symbol"] == ".", "debug").when(parts["symbol"] != "#", "info").when(bad, "error").otherwise("warning")


# Words in audit trails and Wi-Fi messages that raise a line's severity.
_AUDIT_FAILURE = r"(?i)\b(?:fail(?:ed|ure)?|denied|invalid|error|reject(?:ed)?|unauthorized|forbidden|lockout|locked)\b"
_WPA_SEEN = r"CTRL-EVENT-|SME:|Trying to associate|WPA:|Trying to authenticate|Associated with|EAP|key negotiation|RSN:|deauthenticat|pre-shared key"
_WPA_ERRORS = ["DISCONNECTED", "AUTH-REJECT", "CONNECTION-LOST", "TEMP-DISABLED", "handshake failed", "WRONG-KEY", "authentication with", "deauthenticat", "failed"]
_WPA_WARNINGS = ["SCAN-FAILED", "ASSOC-REJECT", "retr", "timeout", "Failed to initiate", "reason="]
_PING_ATTACKS = ["connection_drop", "attack", "abuse", "blocked", "decoy", "backend_error"]
_PING_LEVELS = {"information": "info", "mild_warning": "warning", "severe_warning": "warning", "mild_error": "error", "severe_error": "error", "fatal_error": "critical"}


def _wpa(parts: dict[str, Column]) -> Column:
    return F.when(S.any_phrase(parts["message"], _WPA_ERRORS), "error").when(S.any_phrase(parts["message"], _WPA_WARNINGS), "warning").otherwise("info")


def _audit(parts: dict[str, Column]) -> Column:
    return F.when(parts["level"].isNotNull(), S.level(parts["level"])).when(parts["message"].rlike(_AUDIT_FAILURE), "warning").otherwise("info")


def _answered(parts: dict[str, Column]) -> Column:
    code = F.regexp_extract(parts["message"], r"\|\s*(\d+)\s*$", 1).try_cast("int")
    return F.when(parts["level"].isNotNull(), S.level(parts["level"])).when(code.between(500, 599), "error").when(code.between(400, 499), "warning").otherwise("info")


def _enforced(parts: dict[str, Column]) -> Column:
    low = S.level(parts["level"])
    attack = F.regexp_extract(parts["message"], r"\[type:([^\]]+)\]", 1).isin(_PING_ATTACKS)
    return F.when(attack & low.isin("debug", "info"), "warning").otherwise(low)


FORMATS: list[Format] = [
    Format("kubernetes", gate="^", share=2.0, path="/var/log/pods/|k8s", carry="kubernetes"),
    _json("docker", r'^\s*\{"log"\s*:', "log", ts="time", stream="stream"),
    _line("cri", r"^(\d{4}-\d\d-\d\dT\S+) (stdout|stderr) ([FP]) (.*)$", "ts stream partial message", severity=lambda p: F.when(p["stream"] == "stderr", "warning").otherwise(S.usage(p["message"]))),
    _json("journald", _has("MESSAGE", "__REALTIME_TIMESTAMP"), "MESSAGE", "PRIORITY", "__REALTIME_TIMESTAMP", "epoch_us", _SYSLOG_NUMBERS, source="SYSLOG_IDENTIFIER _COMM"),
    _line("fluentbit", rf"^\[\s*{SLASH}\] \[\s*(\w+)\s*\] (?:\[([^\]]*)\] )?(.*)$", "ts level source message", time="slash"),
    _line("nginx-error", rf"^{SLASH} \[(\w+)\] (\d+)#(\d+): (.*)$", "ts level pid tid message", time="slash", path="nginx.*error"),
    _line("apache-error", rf"^\[{CTIME}\] \[(?:[\w.-]*:)?(\w+)\](?: \[pid [^\]]*\])?(?: \[client ([^\]]*)\])? (.*)$", "ts level client message", time="ctime", path="(apache|httpd).*error"),
    _line("haproxy", rf"^{BSD} (\S+) haproxy\[(\d+)\]: (?:(\S+):\d+ \[[^\]]*\] (\S+) (\S+) \S+ (\d{{3}}) (\d+) .*?)?(.*)$", "ts host pid client frontend backend http_status bytes message", time="3164", severity=lambda p: F.when(p["http_status"] != "", _status(p)).otherwise(_KEYWORDS(p))),
    _line("squid", r"^(\d{9,10}\.\d{3})\s+(\d+) (\S+) (\w+)/(\d{3}) (\d+) (\w+) (\S+) (\S+) (\S+) ?(.*)$", "ts duration client result_code http_status bytes method message ident hierarchy type", time="epoch", severity=_squid, path="squid|proxy"),
    _line("werkzeug", r'^(\S+) - - \[(\d{1,2}/[A-Z][a-z]{2}/\d{4} \d\d:\d\d:\d\d)\] "(\w+ [^"]*)" (\d{3})', "client ts message http_status", time="dmy_slash", severity=_status),
    _line("django", r'^\[(\d{1,2}/[A-Z][a-z]{2}/\d{4} \d\d:\d\d:\d\d)\] "(\w+ [^"]*)" (\d{3}) (\d+)', "ts message http_status bytes", time="dmy_slash", severity=_status),
    _json("json-access", r'^\s*\{(?=.*"request"\s*:\s*"[A-Z]+ [^"]* HTTP)(?=.*"status(?:_code)?"\s*:)', "request", ts="time timestamp time_local @timestamp ts", http_status="status status_code", client="remote_addr client"),
    _line("nginx-access", CLF + r'(?: "([^"]*)" "([^"]*)")?.*$', "client ident user ts message http_status bytes referer agent", time="clf", severity=_status, path="nginx.*access"),
    _line("apache-access", CLF + r".*$", "client ident user ts message http_status bytes", time="clf", severity=_status, path="(apache|httpd).*access"),
    _line("alb", rf"^(https?|h2|wss?) {ISO} (\S+/\S+) (\S+) (\S+) \S+ \S+ \S+ (\d{{3}}|-) \S+ \d+ \d+ \"([^\"]*)\".*$", "type ts elb client target http_status message", severity=_status),
    _line("vpcflow", r"^2 (\d+) (eni-\w+) (\S+) (\S+) (\d+) (\d+) (\d+) (\d+) (\d+) (\d+) (\d+) ((ACCEPT|REJECT) .*)$", "account eni src dst srcport dstport proto packets bytes ts until message action", time="epoch", severity=lambda p: F.when(p["action"] == "REJECT", "warning").otherwise("info")),
    _line("s3access", rf'^[0-9a-f]{{64}} (\S+) \[{CLF_STAMP}\] (\S+) (\S+) (\S+) (\S+) (\S+) "([^"]*)" (\d{{3}}|-) (\S+).*$', "bucket ts client requester id operation key message http_status error", time="clf", severity=_status),
    _line("apparmor", rf'^{BSD} (\S+) kernel: .*?(apparmor="(\w+)".*)$', "ts host message mode", time="3164", share=0.5, severity=lambda p: F.when(p["mode"] == "DENIED", "warning").when(p["mode"] == "ERROR", "error").otherwise("info")),
    _line("auditd", r"^(?:node=\S+ )?type=(\w+) msg=audit\((\d+\.\d+):(\d+)\): ?(.*)$", "type ts serial message", time="epoch", path="audit", severity=lambda p: F.when(p["type"].startswith("ANOM"), "error").when(p["message"].rlike("res(ult)?=[\"']?(failed|no)|denied"), "warning").otherwise("info")),
    _line("ufw", rf"^{BSD} (\S+) kernel: .*?(\[UFW (\w+)\] .*)$", "ts host message action", time="3164", path="ufw", severity=_blocked),
    _line("fail2ban", rf"^{ISO} (fail2ban\.\w+)\s+\[(\d+)\]: (\w+)\s+(?:\[([^\]]+)\] )?(.*)$", "ts source pid level jail message", path="fail2ban", severity=lambda p: F.when(p["message"].rlike(r"^(?i:ban)\b"), "warning").otherwise(S.level(p["level"]))),
    _line("cef", r"^(?:" + BSD + r" (\S+) )?CEF:\d+\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$", "ts host source product version id message level extension", time="3164", levels={"10": "critical", "9": "critical", "8": "error", "7": "error", "6": "warning", "5": "warning", "4": "warning", "very-high": "critical", "high": "error", "medium": "warning", "low": "info"}),
    _line("leef", r"^(?:" + BSD + r" (\S+) )?LEEF:[\d.]+\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$", "ts host source product version message extension", time="3164"),
    _line("ciscoasa", r"^(?:<\d+>)?([A-Z][a-z]{2}\s+\d{1,2}(?: \d{4})? \d\d:\d\d:\d\d)?.*?%([A-Z]+)-(\d)-(\d+): (.*)$", "ts source level id message", time="3164", gate=r"%[A-Z]+-\d-\d+: ", levels=_SYSLOG_NUMBERS),
    _line("snort", r"^(\d\d/\d\d-\d\d:\d\d:\d\d\.\d+)\s+\[\*\*\] \[([\d:]+)\] (.*?) \[\*\*\](?:.*?\[Priority: (\d)\])?.*$", "ts sid message level", time="monthday", levels={"1": "error", "2": "warning", "3": "info", "": "warning"}),
    Format("zeek", gate=r"^(?:#fields.*\t|#separator|#path)", carry="zeek"),
    _line("fortigate", r"^.*?date=(\S+) time=(\S+) .*?level=\"?(\w+)\"?.*?(?:msg=\"([^\"]*)\")?.*$", "date clock level message", gate=r"date=\S+ time=\S+ .*(?:devid|logid)="),
    _syslog("sudo", "sudo", _words((["authentication failure", "incorrect password", "not in sudoers", "not allowed"], "warning"))),
    _syslog("cron", "(?i:cron)d?|CRON|anacron", path="cron"),
    _syslog("dhcpd", "dhcpd", path="dhcpd"),
    _syslog("named", "named", path="named|bind"),
    _syslog("dovecot", "dovecot", _words((["auth failed", "authentication failure", "unknown user", "password mismatch"], "warning"), (_BAD, "error"))),
    _syslog("samba", "smbd|nmbd|winbindd|samba", path="samba|smbd"),
    _syslog("chrony", "chronyd|ntpd|systemd-timesyncd", path="chrony|ntp"),
    _syslog("vsftpd", "vsftpd", _words((["fail"], "warning"))),
    _line("ftp", r"^([A-Z][a-z]{2} [A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d \d{4}) (?:\[pid (\d+)\] (?:\[([^\]]+)\] )?((?:OK|FAIL|CONNECT)? ?[A-Z_ ]+: .*)|(\d+ \S+ \d+ \S+ [ab] [_\w] [io] [agr] \S+ \S+ \d+ \S+ ([ci]).*))$", "ts pid user message bare completion", time="ctime", gate=r"\[pid \d+\] (?:OK|FAIL|CONNECT)|^\w{3} \w{3}\s+\d+ \d\d:\d\d:\d\d \d{4} \d+ \S+ \d+ /", path="vsftpd|proftpd|xferlog|ftpd", severity=lambda p: F.when((p["completion"] == "i") | p["message"].startswith("FAIL "), "warning").otherwise("info")),
    _syslog("dnsmasq", "dnsmasq", path="dnsmasq"),
    _syslog("powerdns", "pdns", path="pdns|powerdns"),
    _syslog("slapd", "slapd", path="slapd|openldap"),
    _syslog("networkmanager", "NetworkManager", lambda p: F.when(p["message"].startswith("<error>"), "error").when(p["message"].startswith("<warn>"), "warning").otherwise(_KEYWORDS(p))),
    _syslog("firewalld", "firewalld", lambda p: S.level(F.regexp_extract(p["message"], r"^(\w+):", 1))),
    _line("pfsense", rf"^{BSD} (?:(\S+) )?filterlog(?:\[\d+\])?: ((?:[^,]*,){{4}}([^,]*),[^,]*,(\w+),(\w+),.*)$", "ts host message iface action direction", time="3164", tag="filterlog", severity=_blocked),
    _syslog("keepalived", "Keepalived", path="keepalived"),
    _syslog("strongswan", "charon|ipsec", path="strongswan|charon"),
    _syslog("smartd", "smartd", path="smartd"),
    _syslog("sendmail", "sendmail|sm-mta", _words((["user unknown", "service unavailable", "rejected"], "error"), (["deferred", "timeout"], "warning"))),
    _syslog("opensmtpd", "smtpd", _words((["permfail", "failed"], "error"), (["tempfail", "timeout"], "warning")), gate=r" smtpd\[\d+\]: .*(?:result=|smtp (?:connected|envelope))"),
    _syslog("sssd", "sssd", _words((_ODD, "warning"), (_BAD, "error"))),
    _syslog("puppet", "puppet", path="puppet"),
    _syslog("zfs", "zed"),
    _syslog("mdadm", "mdadm|mdmonitor", _words((["fail", "degraded"], "error"), (["rebuild", "sparesmissing", "newarray"], "warning"))),
    _syslog("spamassassin", "spamd", _words((["result: y", "identified spam"], "warning"), (_BAD, "error"))),
    _syslog("opendkim", "opendkim"),
    _syslog("frr", "zebra|bgpd|ospfd|ospf6d|ripd|ripngd|isisd|pimd|ldpd|nhrpd|eigrpd|babeld|sharpd|pbrd|staticd|bfdd|fabricd|vrrpd|watchfrr"),
    _syslog("dbus", "dbus-daemon|dbus"),
    _syslog("polkit", "polkitd"),
    _syslog("snapd", "snapd"),
    _syslog("bluetoothd", "bluetoothd"),
    _syslog("avahi", "avahi-daemon"),
    _syslog("syslogng", "syslog-ng"),
    _syslog("rsyslog", "rsyslogd"),
    _line("xorg", r"^\[\s*(\d+\.\d+)\] \((II|WW|EE|NI|\?\?|==|--|\*\*|\+\+|!!)\) (.*)$", "uptime level message", levels={"EE": "error", "WW": "warning", "NI": "warning"}),
    _line("wpa_supplicant", rf"^(?:{BSD} \S+ wpa_supplicant(?:\[\d+\])?: (?=.*(?:{_WPA_SEEN}))(?:([a-z]+\d+|p2p-dev-\w+): )?(.*)|(?=.*(?:{_WPA_SEEN}))([a-z]+\d+|p2p-dev-\w+): (.*))$", "ts interface message bare_interface bare", time="3164", severity=_wpa),
    _syslog("kernel", "kernel", _words((["out of memory", "oom-kill", "oom_reaper", "kernel panic", "hardware error", "machine check", "i/o error"], "critical"), (_BAD + ["segfault", "call trace"], "error"), (_ODD, "warning")), path="kern|dmesg"),
    _syslog("secure", "sshd|su|login|systemd-logind|pam", lambda p: F.when(p["message"].rlike("(?i)failed password|authentication failure|invalid user|failed publickey"), "warning").when(p["message"].rlike("(?i)accepted|session opened|session closed"), "info").otherwise(S.syslog(p["message"])), path=r"(^|/)(secure|auth\.log)"),
    _json("kubeaudit", _has("kind", "apiVersion", "verb", "auditID"), "requestURI", ts="requestReceivedTimestamp stageTimestamp", http_status="responseStatus.code", method="verb"),
    _json("cloudtrail", _has("eventSource", "eventName", "eventTime"), "eventName", ts="eventTime", error="errorCode", client="sourceIPAddress"),
    _json("vaultaudit", _has("type", "auth", "request"), "request.path", ts="time", error="error", method="request.operation"),
    _json("terraform", _has("@level", "@message", "@module"), "@message", "@level", "@timestamp", source="@module"),
    _json("gitlab", _has("severity", "time", "correlation_id"), "message path", "severity", "time", http_status="status", method="method"),
    _json("gcp", _has("severity", "timestamp", "resource"), "textPayload jsonPayload.message protoPayload.methodName", "severity", "timestamp", source="resource.type"),
    _json("azure", _has("operationName", "category"), "operationName", "level Level", "time", result="resultType"),
    _json("suricata", _has("event_type", "timestamp"), "alert.signature event_type", "alert.severity", "timestamp", levels={"1": "critical", "2": "error", "3": "warning"}, client="src_ip"),
    _json("wazuh", _has("rule", "agent", "manager"), "rule.description", "rule.level", "timestamp", levels={**{str(n): "warning" for n in range(4, 8)}, **{str(n): "error" for n in range(8, 12)}, **{str(n): "critical" for n in range(12, 17)}}, source="agent.name"),
    _json("minio", _has("errKind", "level", "time"), "message", "level", "time"),
    _json("nextcloud", r'^\s*\{(?=.*"reqId"\s*:)(?=.*"level"\s*:)(?=.*"(?:app|message)"\s*:)', "message", "level", "time", levels={"0": "debug", "1": "info", "2": "warning", "3": "error", "4": "critical"}, source="app"),
    _json("falco", _has("priority", "rule", "output"), "output", "priority", "time", source="hostname"),
    _json("osquery", _has("hostIdentifier", "columns"), "name", ts="unixTime", time="epoch", action="action", source="hostIdentifier"),
    _json("okta", _has("eventType", "actor"), "displayMessage", "severity", "published", result="outcome.result"),
    _json("cloudflare", _has("RayID", "EdgeResponseStatus"), "ClientRequestURI", ts="EdgeStartTimestamp", http_status="EdgeResponseStatus", source="ClientRequestHost", method="ClientRequestMethod"),
    _json("kong", _has("latencies", "request", "response"), "request.uri", ts="started_at", time="epoch_ms", http_status="response.status", method="request.method"),
    _json("serilog", r'^\s*\{(?=.*"@t"\s*:)(?=.*"@mt?"\s*:)', "@m @mt", "@l", "@t"),
    _json("bunyan", _has("v", "name", "level", "msg", "time"), "msg", "level", "time", levels=_LEVEL_NUMBERS, source="name"),
    _json("pino", r'^\s*\{(?=.*"level"\s*:\s*\d+)(?=.*"time"\s*:\s*\d+)(?=.*"msg"\s*:)', "msg", "level", "time", "epoch_ms", _LEVEL_NUMBERS, source="name"),
    _json("gelf", _has("version", "short_message", "host"), "short_message", "level", "timestamp", "epoch", _SYSLOG_NUMBERS, source="host"),
    _json("filebeat", _has(r"log\.level", "@timestamp", "message"), "message", "log.level", "@timestamp", source="service.name"),
    _json("winston", r'^\s*\{(?=.*"level"\s*:\s*")(?=.*"message"\s*:)(?=.*"timestamp"\s*:)', "message", "level", "timestamp", source="service"),
    _json("otel", _has("msg", "level", "kind"), "msg", "level", "ts timestamp", source="name"),
    _json("etcd", _has("caller", "ts", "msg", "level"), "msg", "level", "ts", source="logger"),
    _json("caddy", _has("logger", "ts", "msg", "level"), "msg", "level", "ts", "epoch", http_status="status", source="logger"),
    _json("traefik", r'^\s*\{(?=.*"level"\s*:)(?=.*"time"\s*:\s*")(?=.*"(?:msg|message)"\s*:)', "message msg", "level", "time"),
    _json("mongodb", r'^\s*\{\s*"t"\s*:\s*\{\s*"\$date"', "msg", "s", "t.$date", levels={"F": "critical", "E": "error", "W": "warning", "I": "info"}, source="c"),
    _line("logstash", rf"^\[{ISO}\]\[{LEVEL}\s*\]\[(logstash[^\]]*?)\s*\] ?(.*)$", "ts level source message"),
    _line("elasticsearch", rf"^\[{ISO}\]\[{LEVEL}\s*\]\[([^\]]*?)\s*\] (?:\[([^\]]*)\] ?)?(.*)$", "ts level logger node message"),
    _line("kafka", rf"^\[{ISO}\] {LEVEL} (.*?)(?: \(([\w.$]+)\))?$", "ts level message logger"),
    _line("rabbitmq", rf"^{ISO} \[(\w+)\] <([\d.]+)> (.*)$", "ts level pid message"),
    _line("gunicorn", rf"^\[{ISO}\] \[(\d+)\] \[(\w+)\] (.*)$", "ts pid level message"),
    _line("php-fpm", rf"^\[{DMY}\] (NOTICE|WARNING|ERROR|ALERT|DEBUG): (.*)$", "ts level message", time="dmy", path="fpm"),
    _line("tomcat", rf"^{DMY} (SEVERE|WARNING|INFO|CONFIG|FINE|FINER|FINEST) \[([^\]]*)\] (\S+) (.*)$", "ts level thread logger message", time="dmy", levels=_JUL),
    _line("zookeeper", rf"^{ISO} (?:\[myid:\d*\] )?- {LEVEL}\s+\[([^\]]*)\] - (.*)$", "ts level thread message"),
    _line("hashicorp", rf"^\s*{ISO} \[{LEVEL}\]\s+([\w.-]+): (.*)$", "ts level source message", path="consul|vault|nomad"),
    _line("supervisor", rf"^{ISO} (CRIT|ERRO|WARN|INFO|DEBG|TRAC|BLAT) (.*)$", "ts level message", levels={"CRIT": "critical", "ERRO": "error", "WARN": "warning", "DEBG": "debug", "TRAC": "debug", "BLAT": "debug"}, gate=rf"^{ISO} (?:CRIT|ERRO|WARN|INFO|DEBG|TRAC) (?:supervisord|spawned|success|exited|received|waiting|Set uid|RPC interface|daemonizing|stopped|reaped|gave up|killing)"),
    _line("celery", rf"^\[{ISO}: {LEVEL}/(\S+?)\] (.*)$", "ts level process message"),
    _line("cups", rf"^([DIWECAXN]) \[{CLF_STAMP}\] (.*)$", "level ts message", time="clf"),
    _line("openvpn", rf"^{CTIME} (.*(?:openvpn|OpenVPN|TLS|VERIFY|Peer Connection|MULTI|Initialization Sequence).*)$", "ts message", time="ctime", severity=_KEYWORDS),
    _line("hbase", rf"^{ISO} {LEVEL}\s+\[([^\]]*)\] (\S*): (.*)$", "ts level thread logger message", gate=r"hbase|RegionServer|HMaster"),
    _line("hive", rf"^{ISO} {LEVEL}\s+\[([^\]]*)\]:? (\S*): (.*)$", "ts level thread logger message", gate=r"HiveServer2|apache\.hive|hive\.ql|ql\.Driver"),
    _line("flink", rf"^{ISO} {LEVEL}\s+(\S+)\s+(?:\[[^\]]*\] )?- (.*)$", "ts level logger message", gate=r"flink"),
    _line("druid", rf"^{ISO} {LEVEL}\s+\[([^\]]*)\] (\S+) - (.*)$", "ts level thread logger message", gate=r"druid"),
    _line("trino", rf"^{ISO}\s+{LEVEL}\s+(\S+)\s+(\S+)\s+(.*)$", "ts level thread logger message", gate=r"trino|presto"),
    _line("solr", rf"^{ISO} {LEVEL}\s+\(([^)]*)\) \[([^\]]*)\] (.*)$", "ts level thread context message"),
    _line("patroni", rf"^{ISO} {LEVEL}: (.*)$", "ts level message", share=0.5, path="patroni"),
    _line("chef", rf"^\[{ISO}\] {LEVEL}: (.*)$", "ts level message"),
    _line("podman", rf"^(\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d)(?:\.\d+)? [+-]\d{{4}} \w+ m=\S+ ((?:container|image|pod|volume|network) (\w+) .*)$", "ts message action", severity=lambda p: F.when(p["action"].isin("oom", "died", "remove", "kill"), "error").when(p["action"].isin("stop", "pause", "restart", "cleanup"), "warning").otherwise("info")),
    _line("ceph", rf"^{ISO} (\w{{6,}})\s+(-?\d+) (.*(?:mon\.|osd\.|mgr\.|mds\.|ceph|cluster).*)$", "ts thread priority message", severity=lambda p: F.when(p["message"].contains("[ERR]"), "error").when(p["message"].contains("[WRN]"), "warning").when(p["message"].contains("[INF]"), "info").when(p["message"].contains("[DBG]"), "debug").otherwise(_KEYWORDS(p))),
    _line("coredns", rf"^(?:{ISO} )?\[{LEVEL}\] (.*)$", "ts level message", gate=r"plugin/|\[INFO\] \S+:\d+ - \d+|CoreDNS"),
    _line("qemu", rf"^(?:{ISO} )?(qemu[\w-]*): (.*)$", "ts source message", severity=_KEYWORDS),
    _line("wildfly", rf"^(\d\d:\d\d:\d\d,\d+) {LEVEL}\s+\[([^\]]*)\] \(([^)]*)\) (.*)$", "clock level logger thread message"),
    _line("kibana", rf"^\s*log\s+\[(\d\d:\d\d:\d\d\.\d+)\] \[(\w+)\](\S*) (.*)$", "clock level tags message"),
    _line("puma", r"^\[(\d+)\] ([*!-]) (.*)$", "pid level message", levels={"!": "error", "*": "info", "-": "info"}),
    _line("monit", rf"^\[\w+ ([A-Z][a-z]{{2}}\s+\d{{1,2}} \d\d:\d\d:\d\d)\] (\w+)\s*: (.*)$", "ts level message", time="3164"),
    _line("yum", rf"^{BSD} ((?:Installed|Updated|Erased|Obsoleted|Upgraded|Removed): .*)$", "ts message", time="3164", share=0.5),
    _line("krb5kdc", rf"^{BSD} (?:(\S+) )?(krb5kdc|kadmind)\[(\d+)\]\((\w+)\): (.*)$", "ts host source pid level message", time="3164"),
    _line("dmesg", r"^\[\s*(\d+\.\d{6})\] (.*)$", "uptime message", severity=_words((["out of memory", "oom-kill", "oom_reaper", "kernel panic", "hardware error", "machine check", "i/o error"], "critical"), (_BAD + ["segfault", "call trace"], "error"), (_ODD, "warning"))),
    _line("mikrotik", rf"^{BSD} (?:(\S+) )?((?:\w+,)+\w+) (.*)$", "ts host topics message", time="3164", share=0.5, severity=lambda p: S.level(F.regexp_extract(p["topics"], r".*\b(critical|error|warning|info|debug)\b", 1))),
    Format("iis", gate=r"^#Fields:(?!.*x-edge-location)(?!.*\t.*\S)(?=.*(?:s-ip|time-taken|sc-status))", carry="iis"),
    Format("cloudfront", gate=r"^#Fields:.*x-edge-location", carry="cloudfront"),
    Format("oracle", gate=r"\b(?:ORA|TNS)-\d{4,5}\b", also=r"Starting ORACLE instance|Instance shutdown|ALTER DATABASE", path=r"alert[^/]*$", carry="oracle"),
    Format("oracle", gate=r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?[+\-Z]", share=2.0, path=r"alert[^/]*$", carry="oracle"),
    _line("mysql", r"^(\d{4}-\d\d-\d\d[T ]\s*\d{1,2}:\d\d:\d\d(?:\.\d+)?Z?)\s+(\d+)\s+\[(\w+)\](?: \[[^\]]*\])*\s*(.*)$", "ts thread level message", gate=r"\d{4}-\d\d-\d\d[T ]\s*\d{1,2}:\d\d:\d\d.*\[(?:ERROR|Warning|Note|System)\]|# User@Host:|# Query_time:", path="mysql|mariadb", levels={"Note": "info", "System": "info"}, carry="mysql", least=0.1),
    _line("uwsgi", r"^\[pid: (\d+)\|.*?\] (\S+) \(\) \{[^}]*\} \[[^\]]*?([A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d \d{4})\] (.*?\(HTTP/[\d.]+ (\d{3})\).*)$", "pid client ts message http_status", time="ctime", severity=_status),
    _line("rails", r"^(?:\S, \[(\S+) #\d+\]\s+\w+ -- : )?(?:\[\S+\] )?((?:Started [A-Z]+ |Completed )(?:(\d{3}) )?.*)$", "ts message http_status", severity=lambda p: F.when(p["http_status"].isNull() | (p["http_status"] == ""), "info").otherwise(_status(p))),
    _line("exim", rf"^(\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d) ((?:\w{{6}}-\w{{6,11}}-\w{{2,4}}) (<=|=>|->|\*\*|==|Completed)?.*)$", "ts message flag", path="exim|mainlog", severity=lambda p: F.when(p["flag"] == "**", "error").when((p["flag"] == "==") | p["message"].rlike("(?i)reject|error"), "warning").otherwise("info")),
    _line("paloalto", r"^(?:.*?,)?(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d),(\w*),(TRAFFIC|THREAT|SYSTEM|CONFIG|HIPMATCH|GLOBALPROTECT),([\w-]*),(.*)$", "ts serial type subtype message", time="slash", severity=lambda p: F.when(p["message"].rlike("(?i)\\bcritical\\b"), "critical").when(p["message"].rlike("(?i)\\bhigh\\b"), "error").when(p["message"].rlike("(?i)\\b(medium|deny|drop|reset-\\w+)\\b"), "warning").otherwise("info")),
    _json("otlp", r'^\s*\{(?=.*"(?:body|Body)"\s*:)(?=.*"(?:severityText|severityNumber|SeverityText|severity_text)"\s*:)', "body.stringValue body Body", "severityText SeverityText severity_text", "timeUnixNano time_unix_nano Timestamp", "epoch_ns"),
    _json("klog-json", r'^\s*\{(?=.*"msg"\s*:)(?=.*"caller"\s*:)(?=.*"ts"\s*:)(?!.*"level"\s*:)', "msg", ts="ts", time="epoch", error="err error"),
    _json("modsecurity", _has("transaction", "audit_data"), "transaction.request.uri transaction.uri", ts="transaction.time_stamp"),
    _json("pingauthorize", r'^\s*\{(?=.*"(?:elapsedTime|requestId)"\s*:)(?=.*"(?:PERMIT|DENY|INDETERMINATE|NOT_APPLICABLE)")', "decision", ts="timestamp time", error="denied"),
    _line("keycloak", rf"^{ISO} {LEVEL}\s+\[((?:org\.keycloak|org\.jboss|io\.quarkus|org\.infinispan)[^\]]*)\] \(([^)]*)\) (.*)$", "ts level logger thread message"),
    _line("pulsar", rf"^{ISO} \[([^\]]+)\] {LEVEL}\s+(\S+) - (.*)$", "ts thread level logger message", gate=rf"^\d{{4}}-\d\d-\d\dT\S+,\d+[+-]\d{{4}} \[[^\]]+\] {LEVEL} "),
    _line("cassandra", rf"^{LEVEL}\s+\[([^\]]+)\] {ISO} (\w+\.java):(\d+) - (.*)$", "level thread ts file line message"),
    _line("pingfederate", rf"^(\d{{4}}-\d\d-\d\d \d{{1,2}}:\d\d:\d\d,\d{{3}}) (?:tid:(\S+) {LEVEL}\s+\[([^\]]*)\]\s*(.*)|\| (?!(?i:trace|debug|info|warn|warning|error|fatal)\s*\|)([^|]*\|[^|]*\|[^|]*\|[^|]*\|.*))$", "ts tid level logger message bare", severity=_audit),
    _line("pingaccess", rf"^(\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d[,.]\d{{3}})(?:\s+{LEVEL}\s+\[([^\]]*)\]\s+([\w.$]*(?:pingidentity|(?i:pingaccess))[\w.$]*):(\d+)\s+-\s+(.*)|\s*\|\s*(.*\d+\s*ms\s*\|.*))$", "ts level exchange_id logger lineno message bare", severity=_answered),
    Format("pingdirectory", r"^\[(\d\d/[A-Za-z]{3}/\d{4}:\d\d:\d\d:\d\d\.\d{3} [-+]\d{4})\]\s+(?:category=(\S+)\s+severity=(\S+)\s+msgID=(\S+)\s+(.*)|((?:CONNECT|DISCONNECT|ABANDON|(?:BIND|UNBIND|SEARCH|ADD|MODIFY|MODIFY DN|MODIFYDN|DELETE|COMPARE|EXTENDED)(?: REQUEST| RESULT| FORWARD| ENTRY| REFERENCE)?)\b)(.*))$", ("ts", "category", "level", "msgID", "rest", "operation", "more"), levels=_PING_LEVELS, carry="pingdirectory"),
    _line("pingintelligence", r"^\[([A-Za-z]{3} [A-Za-z]{3} +\d{1,2} \d\d:\d\d:\d\d:\d{3} \d{4})\] \[thread:(\d+)\] \[(fatal|error|warning|warn|info|debug)\]\s*(.*)$", "ts thread level message", time="ctime", severity=_enforced),
    _line("activemq", rf"^{ISO} \| {LEVEL}\s*\| (.*?) \| (\S+) \| (.*)$", "ts level message logger thread"),
    _line("clickhouse", r"^(\d{4}\.\d\d\.\d\d \d\d:\d\d:\d\d(?:\.\d+)?) \[ (\d+) \] \{([^}]*)\} <(\w+)> (.*)$", "ts thread query level message", time="dotted"),
    _line("mssql", rf"^(\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d\.\d\d) (\w+)\s{{2,}}(.*)$", "ts source message", severity=lambda p: F.when(F.regexp_extract(p["message"], r"Severity: (\d+)", 1).try_cast("int") >= 17, "critical").when(F.regexp_extract(p["message"], r"Severity: (\d+)", 1).try_cast("int") >= 11, "error").otherwise(_KEYWORDS(p))),
    _line("datadog", rf"^{ISO[:-1]} [A-Z]{{3,4}}) \| (\w+) \| {LEVEL} \| \(([^)]*)\) \| (.*)$", "ts agent level where message"),
    _line("freeradius", rf"^{CTIME} : (\w+): (.*)$", "ts level message", time="ctime", levels={"Auth": "info", "Error": "error", "Info": "info", "Proxy": "info"}),
    _line("glusterfs", rf"^\[{ISO}\] ([MACEWNIDT]) (?:\[MSGID: (\d+)\] )?\[([^\]]*)\] (.*)$", "ts level id where message", levels={"M": "critical", "A": "critical", "C": "critical"}),
    _line("libvirt", rf"^{ISO}: (\d+): (\w+) : (\S+) : (.*)$", "ts pid level where message"),
    _line("lxc", rf"^lxc(?:-\S+)? (\S+) (\d{{14}})(?:\.\d+)? {LEVEL}\s+(\S+) - ([^-]+) - (.*)$", "name ts level component where message", time="digits"),
    _line("vmware", rf"^{ISO} cpu\d+:(\d+)(?: opID=\S+)?\)(?:{LEVEL}: )?(.*)$", "ts world level message"),
    _line("pihole", r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+)[^\]]*? (\d+[A-Z]?\d*(?:/\S+)?)\] (?:(ERROR|FATAL|WARNING|INFO|DEBUG)\S*:? )?(.*)$", "ts pid level message"),
    _line("unifi", rf"^\[{ISO}\] <([^>]*)> {LEVEL}\s+(\S+)\s+- (.*)$", "ts thread level logger message"),
    _line("laravel", rf"^\[{ISO}\] (\w+)\.{LEVEL}: (.*)$", "ts env level message"),
    _line("phperror", rf"^\[{DMY}(?: \S+)?\] PHP ([\w ]+?):\s+(.*)$", "ts level message", time="dmy", levels={"fatal error": "critical", "parse error": "error", "warning": "warning", "notice": "info", "deprecated": "info"}),
    _line("jetty", rf"^{ISO}:{LEVEL}:([\w.$]+):([^:]*): (.*)$", "ts level logger thread message", gate=rf"^{ISO}:{LEVEL}:(?:\w+\.)*(?:jetty|oej\w*|eclipse)[\w.$]*:"),
    _line("rspamd", rf"^{ISO} #(\d+)\((\w+)\) (?:<(\w*)>; )?(\w+); (.*)$", "ts pid worker id module message", severity=_KEYWORDS),
    _line("cockroachdb", r"^([IWEF])(\d{6} \d\d:\d\d:\d\d)\.\d+ (\d+) (\S+:\d+)\s+(?:⋮ )?(?:\[([^\]]*)\]\s+)?(.*)$", "level ts goroutine where tags message", time="compact", levels=_GO),
    _line("klog", r"^([IWEF])(\d{4} \d\d:\d\d:\d\d\.\d+)\s+(\d+) (\S+:\d+)\] (.*)$", "level ts thread caller message", time="klog", levels=_GO, share=0.5),
    _line("logrus", r'^time="([^"]*)" level=(\w+) msg="?((?:[^"\\]|\\.)*?)"?(?: .*)?$', "ts level message"),
    _line("envoy", rf"^\[{ISO}\]\[(\d+)\]\[(\w+)\]\[(\w+)\] (.*)$", "ts thread level source message", path="envoy|istio"),
    _line("cloudinit", rf"^{ISO} - (\S+?)\[{LEVEL}\]: (.*)$", "ts logger level message", path="cloud-init"),
    _line("telegraf", rf"^{ISO} ([DIWE])! \[([^\]]+)\] (.*)$", "ts level source message", levels=_GO, gate=r"[DIWE]! \[(?:inputs|outputs|agent|telegraf|processors|aggregators)(?!\.cloudwatch)"),
    _line("cloudwatch", rf"^(\d{{4}}[-/]\d\d[-/]\d\d[T ]\S+) ([DIWE])! (.*)$", "ts level message", levels=_GO),
    _line("jenkins", rf"^{ISO} \[id=(\d+)\]\s+(SEVERE|WARNING|INFO|CONFIG|FINE|FINER|FINEST)\s+(\S+?):? (.*)$", "ts id level logger message", levels=_JUL),
    _line("springboot", rf"^{ISO}\s+{LEVEL} (\d+) --- (?:\[[^\]]*\] )?\[([^\]]*)\] (\S+)\s*: (.*)$", "ts level pid thread source message", fold=True),
    _line("pgbouncer", rf"^{ISO[:-1]} [A-Z]{{3,4}}) \[(\d+)\] (LOG|WARNING|ERROR|FATAL|DEBUG|NOISE) (.*)$", "ts pid level message", levels=_POSTGRES),
    _line("postgresql", rf"^{ISO[:-1]} [A-Z]{{3,4}}) \[(\d+)\](?: (\S+@\S+))? ?(LOG|WARNING|ERROR|FATAL|PANIC|DETAIL|HINT|STATEMENT|CONTEXT|NOTICE|INFO|DEBUG\d?):\s+(.*)$", "ts pid user level message", levels=_POSTGRES, path="postgres"),
    _line("redis", r"^(?:(\d+):([XCSM])|\[(\d+)\]) (\d{1,2} [A-Z][a-z]{2} (?:\d{4} )?\d\d:\d\d:\d\d\.\d+) ([.*#-]) (.*)$", "pid role pid_old ts symbol message", time="day_month", path="redis", severity=_redis),
    _syslog("postfix", "postfix", lambda p: F.when(p["message"].rlike("(?i)fatal|panic|error:"), "error").when(p["message"].rlike("(?i)authentication failed|reject|status=(?!sent)"), "warning").otherwise("info"), path="mail"),
    _line("logfmt", r'^(?=.*\blevel="?(\w+))(?=.*\bmsg=(?:"((?:[^"\\]|\\.)*)"|(\S+)))(?=.*\b(?:ts|time|timestamp)="?([^"\s]+)).*$', "level message bare ts", share=0.5),
    _line("githubactions", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{7}Z) (?:##\[(\w+)\])?(.*)$", "ts level message", share=0.5),
    _line("uvicorn", rf"^{LEVEL}:\s{{2,}}(.*)$", "level message", share=0.5),
    _line("nats", rf"^\[(\d+)\] {SLASH} \[(INF|WRN|ERR|DBG|TRC|FTL)\] (.*)$", "pid ts level message", time="slash", levels={"INF": "info", "WRN": "warning", "ERR": "error", "DBG": "debug", "TRC": "debug", "FTL": "critical"}),
    _line("asterisk", rf"^\[{BSD}\] (VERBOSE|NOTICE|WARNING|ERROR|DEBUG|SECURITY)\[(\d+)\](?:\[\S+\])? (.*)$", "ts level thread message", time="3164", levels={"SECURITY": "warning", "VERBOSE": "info"}),
    _line("unbound", r"^\[(\d{9,10})\] unbound\[[\d:]+\] (\w+): (.*)$", "ts level message", time="epoch"),
    _line("nagios", r"^\[(\d{9,10})\] ((?:SERVICE|HOST|CURRENT|EXTERNAL|PASSIVE)[A-Z ]*: .*)$", "ts message", time="epoch", severity=_words((["critical", ";down"], "error"), (["warning", "unknown", "unreachable"], "warning"))),
    _line("dpkg", rf"^{ISO} ((?:install|upgrade|remove|purge|configure|trigproc|status|startup|conffile) .*)$", "ts message", share=0.5, path="dpkg", severity=_words((["half-"], "warning"))),
    _line("airflow", rf"^\[{ISO}\] \{{([^}}]*)\}} {LEVEL} - (.*)$", "ts where level message"),
    _line("sidekiq", rf"^{ISO} ((?:\d+ )?TID-\S+|pid=\d+ tid=\S+)[^:]*? {LEVEL}: (.*)$", "ts header level message"),
    _line("saltstack", rf"^{ISO} \[(salt[^:\]]*):?\d*\s*\]\[{LEVEL}\s*\]\[(\d+)\] (.*)$", "ts source level pid message"),
    _line("certbot", rf"^{ISO}:{LEVEL}:((?:certbot|acme)[\w.]*):(.*)$", "ts level logger message"),
    _line("neo4j", rf"^{ISO} {LEVEL}\s+\[([^\]]+)\] (.*(?:neo4j|Bolt|Database|database|transaction).*)$", "ts level logger message"),
    _line("hadoop", rf"^{ISO} {LEVEL}\s+((?:org\.apache\.hadoop|BlockStateChange|namenode|datanode)[\w.$]*): (.*)$", "ts level logger message"),
    _line("spark", rf"^(\d\d/\d\d/\d\d \d\d:\d\d:\d\d) {LEVEL} ([\w.$]+): (.*)$", "ts level logger message", time="short"),
    _line("jvmgc", r"^\[(\d{4}-\d\d-\d\dT[^\]]*|\d+\.\d+s)\](?:\[\d+\.\d+s\])?\[(\w+)\s*\]\[(gc[^\]]*)\] (.*)$", "ts level tags message"),
    _line("lighttpd", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d): \(([\w.-]+\.c\.\d+)\) (.*)$", "ts where message", severity=_KEYWORDS),
    _line("zabbix", r"^\s*(\d+):(\d{8}:\d{6})\.\d+ (.*)$", "pid ts message", time="colon", severity=_KEYWORDS),
    _line("clamav", rf"^{CTIME} -> (.*)$", "ts message", time="ctime", severity=_words((["found"], "critical"), (["error"], "error"), (["outdated", "warning"], "warning"))),
    _line("pylogging", rf"^{ISO} - ([\w.]+) - {LEVEL} - (.*)$", "ts source level message", share=0.5, fold=True),
    _line("log4j", rf"^{ISO} \[([^\]]+)\] {LEVEL}\s+([\w.$]+)\s+- (.*)$", "ts thread level source message", share=0.5, fold=True),
    _line("mosquitto", r"^(\d{9,10}): (.*(?:mosquitto|client|Client|connection|listen).*)$", "ts message", time="epoch", severity=_words((["error"], "error"), (["disconnect", "refused"], "warning"))),
    _line("maven", r"^\[(INFO|WARNING|ERROR|DEBUG)\] (.*)$", "level message", share=0.5),
    _line("npm", r"^npm (ERR!|error|WARN|warn|notice|info|http|verb|silly)\s+(.*)$", "level message", levels={"err!": "error", "verb": "debug", "silly": "debug"}),
    _line("rsyncd", rf"^{SLASH} \[(\d+)\] (.*(?:rsync|module|connect from|sent \d+ bytes|building file list).*)$", "ts pid message", time="slash", severity=_words((_ODD, "warning"), (_BAD, "error"))),
    _line("tailscale", rf"^{SLASH} ([\w.-]+): (.*)$", "ts source message", time="slash", gate=r"(?:magicsock|tailscale|wgengine|control(?:client)?|netcheck|derp)", severity=_words((_BAD + _ODD, "warning"))),
    _line("wireguard", rf"^{SLASH} (.*(?:wireguard|peer\(|handshake|[Kk]eepalive).*)$", "ts message", time="slash", severity=_words((_BAD + _ODD + ["did not complete"], "warning"))),
    _line("gitea", rf"^{SLASH} (\S+\.go:\d+:\S+) \[([TDIWECF])\] (.*)$", "ts where level message", time="slash"),
    _line("gostdlib", rf"^{SLASH} (?:(\w+\.go:\d+): )?(.*)$", "ts where message", time="slash", share=0.5, severity=_KEYWORDS),
    _line("ansible", r"^((?:PLAY|TASK|RUNNING HANDLER) \[.*|PLAY RECAP.*|(ok|changed|skipping|failed|fatal|unreachable|included): .*|\S+\s+: ok=\d+.*(failed=[1-9]).*|\S+\s+: ok=\d+.*|\[WARNING\].*)$", "message status failed", share=0.5, severity=lambda p: F.when(p["failed"].isNotNull() | p["status"].isin("failed", "fatal", "unreachable"), "error").when(p["message"].startswith("[WARNING]"), "warning").otherwise("info")),
    _line("composelog", r"^([\w.-]+)\s+\| (.*)$", "source message", share=0.5, severity=lambda p: S.usage(p["message"])),
    _line("apthistory", rf"^((?:Start-Date|End-Date|Commandline|Requested-By|Install|Upgrade|Remove|Purge|Error): ?(?:(\d{{4}}-\d\d-\d\d\s+\d\d:\d\d:\d\d))?.*)$", "message ts", share=0.5, severity=lambda p: F.when(p["message"].startswith("Error"), "error").otherwise("info")),
    _line("gradle", r"^(> Task (\S+)(?: (\S+))?|BUILD (?:FAILED|SUCCESSFUL).*|FAILURE: .*|[we]: .*|\* What went wrong:.*|.+)$", "message task status", gate=r"^(?:> Task :|BUILD (?:FAILED|SUCCESSFUL) in)", severity=lambda p: F.when(p["message"].rlike("FAILED|^FAILURE|^e: "), "error").when(p["message"].startswith("w: "), "warning").otherwise("info")),
    _line("bazel", r"^(INFO|WARNING|ERROR|DEBUG|FAILED): (.*)$", "level message", gate=r"^(?:INFO|ERROR|WARNING|FAILED): (?:Analyzed|Build|Found|Elapsed|Invocation|//)", levels={"FAILED": "critical"}),
    _line("pip", r"^(?:(ERROR|WARNING|DEPRECATION): )?(.*)$", "level message", gate=r"^(?:Collecting \S|Successfully installed|Requirement already satisfied|  Downloading )"),
    _line("phoenix", r"^(\d\d:\d\d:\d\d\.\d{3}) \[(\w+)\] (.*)$", "clock level message", share=0.5),
    _line("syslog", rf"^(?:<\d+>)?(?:{BSD}|{ISO}) (\S+) ([\w./()-]+)(?:\[(\d+)\])?: (.*)$", "bsd ts host source pid message", path=r"(^|/)(messages|syslog)", severity=lambda p: S.syslog(F.concat_ws(" ", p["source"], p["message"]))),
    _line("generic", rf"^(?=\S|\s+\S)(?:.*?{ISO})?.*$", "ts", gate=r"^", severity=lambda p: S.usage(p["message"])),
]

ALIASES = {"nginx": "nginx-access", "apache": "apache-access", "httpd": "apache-access", "k8s": "kubernetes", "ssh": "secure", "dnf": "yum", "journal": "journald", "pingdirectoryproxy": "pingdirectory", "pingdatasync": "pingdirectory", "pingdatametrics": "pingdirectory", "pingdatagovernance": "pingauthorize", "auth": "secure", "sshd": "secure", "postgres": "postgresql", "mongo": "mongodb", "elastic": "elasticsearch", "messages": "syslog", "dmesg": "kernel", "mail": "postfix"}

BY_NAME = {f.name: f for f in reversed(FORMATS)}
