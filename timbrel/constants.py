"""Phrases, level words, thresholds and texts that results depend on."""

# Level words; any other word counts as info.
LEVEL_WORDS = {
    "debug": "trace debug dbug",
    "info": "info information informational notice default",
    "warning": "warn warning wrn",
    "error": "error err eror severe",
    "critical": "crit critical alert emerg emergency fatal panic dpanic",
}
LEVEL_LETTERS = {"d": "debug", "i": "info", "n": "info", "w": "warning", "e": "error", "c": "critical", "f": "critical"}

# Final order of signals.
SEVERITY_ORDER = ["critical", "error", "warning", "info", "debug", "unknown"]

# Phrases looked for in lower-cased messages.
AUTH_PHRASES = ["failed password", "invalid user", "authentication failure", "invalid credentials"]
OOM_PHRASES = ["out of memory", "oom-kill", "oomkilled", "oom_reaper", "oom killer"]
CRASH_PHRASES = ["main process exited", "failed with result 'signal'", "segfault", "core dumped", "killed process", "crashloopbackoff", "back-off restarting failed container", "kernel panic"]
WEAK_CRASH_PHRASES = ["failed to start", "panic:"]
DISK_PHRASES = ["no space left on device", "disk full", "quota exceeded"]

# Thresholds.
MIN_SPIKE_ERRORS = 5
MIN_BURST_EVENTS = 10
UNTIMED_SHARE = 0.2
BYPASS_EVENTS = 20
BYPASS_SHARE = 0.9
BASELINE_WINDOW_MINUTES = 5
SAMPLES = 20
MERGED_SAMPLES = 5
FINDINGS = 5
LEAST_HOURS = 1 / 3600

# Firewall sources and actions; proxy codes and ports.
FIREWALL_SOURCES = ["ufw", "filterlog", "firewalld"]
BLOCK_ACTIONS = ["block", "reject", "drop"]
CACHEABLE_CODES = ["TCP_MISS", "TCP_HIT", "TCP_MEM_HIT", "TCP_REFRESH_HIT"]
SAFE_PORTS = [80, 443, 8080, 8443]

# Signal kinds: category, headline.
KIND_CATEGORY = {
    "oom_event": "oom",
    "service_crash": "service_crash",
    "disk_full": "disk_full",
    "auth_failure_cluster": "auth_brute_force",
    "proxy_denial_cluster": "network_issue",
    "tunnel_anomaly": "network_issue",
    "firewall_block_cluster": "network_issue",
}
KIND_HEADLINE = {
    "error_burst": "Error burst detected",
    "rate_spike": "Error rate spike vs baseline",
    "auth_failure_cluster": "Authentication failure cluster",
    "oom_event": "OOM killer fired",
    "service_crash": "Service crashed",
    "disk_full": "Disk full event",
    "proxy_denial_cluster": "Proxy ACL denial cluster",
    "firewall_block_cluster": "Firewall block flood",
    "tunnel_anomaly": "Suspicious CONNECT tunnel detected",
    "unknown": "Anomalous event cluster",
}
CATEGORY_TITLE = {
    "oom": "Out of Memory",
    "auth_brute_force": "Auth Brute Force",
    "http_overload": "HTTP Overload",
    "disk_full": "Disk Full",
    "service_crash": "Service Crash",
    "config_error": "Config Error",
    "network_issue": "Network Issue",
}
CLEAN_TITLE = "No incidents detected"
CRITICAL_CATEGORIES = ["oom", "service_crash"]

# Remediation texts, by kind and by category.
KIND_REMEDIATION = {
    "proxy_denial_cluster": "Review Squid ACL rules with `squid -k parse`. Check /etc/squid/squid.conf for overly broad deny rules. Audit denied client IPs in the access log.",
    "tunnel_anomaly": "CONNECT tunnels to non-standard ports may indicate data exfiltration. Review Squid SSL_bump config and consider blocking CONNECT to unusual ports via ACL.",
    "firewall_block_cluster": "A dense burst of firewall blocks usually means a port scan or a misconfigured client. Review the source IPs in the blocked events; rate-limit or drop persistent scanners upstream (e.g. `ufw deny from <ip>`).",
    "error_burst": "Investigate the root service throwing errors. Check upstream connectivity and review recent config changes.",
}
CATEGORY_REMEDIATION = {
    "oom": "Check /proc/meminfo and `dmesg | grep -i oom`. Consider adding swap or tuning vm.overcommit_memory=2 in /etc/sysctl.conf.",
    "auth_brute_force": "Block offending IPs with `firewall-cmd --add-rich-rule` or fail2ban. Review /var/log/secure for source IPs and consider disabling password auth in sshd_config.",
    "http_overload": "Check upstream application health and CPU/memory. Review nginx/apache upstream timeout settings and consider rate limiting.",
    "disk_full": "Run `df -h` to identify full filesystem. Clear logs with `journalctl --vacuum-size=1G` or clean /tmp. Consider adding storage or rotating logs more aggressively.",
    "service_crash": "Run `systemctl status <service>` and `journalctl -u <service> -n 50`. Check for segfaults with `dmesg | grep segfault`.",
    "config_error": "Validate config files with the service built-in check (e.g. `nginx -t`, `apache2ctl configtest`). Review recent config changes with `git log` or `rpm -qa --last`.",
    "network_issue": "Check connectivity with `ping`, `traceroute`, and `ss -tunp`. Review firewall rules with `firewall-cmd --list-all` or `iptables -L`.",
}

# Whole words, one of which must occur before a model's category is believed.
EVIDENCE = {
    "auth_brute_force": ["auth", "authentication", "failed login", "login failed", "failed logon", "logon failure", "password", "passwd", "credential", "credentials", "sshd", "ssh", "invalid user", "fail2ban", "unauthorized", "permission denied", "access denied", "sudo", "pam", "brute", "authorization"],
    "http_overload": ["http", "request", "requests", "upstream", "gateway", "nginx", "gunicorn", "worker", "workers", "502", "503", "504", "too many", "throttled", "throttling", "rate limit", "overload"],
    "disk_full": ["disk", "no space", "space left", "quota", "enospc", "filesystem", "write failed", "read-only", "full"],
    "service_crash": ["crash", "crashed", "segfault", "segmentation", "core dump", "core-dump", "panic", "exited", "killed", "terminated", "abort", "aborted", "signal", "traceback", "exception", "dumped", "coredump"],
    "config_error": ["config", "configuration", "parse", "parsing", "syntax", "invalid", "directive", "malformed", "unexpected"],
    "network_issue": ["network", "connection", "connections", "connect", "unreachable", "refused", "dns", "resolve", "timed out", "timeout", "no route", "reset by peer", "socket", "tls", "handshake"],
    "oom": ["out of memory", "oom", "memory", "cannot allocate", "killed process"],
}
