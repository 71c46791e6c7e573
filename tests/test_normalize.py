from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from scenarios import access_scenario, auth_scenario
from wardlog.operators.formats import detect_format
from wardlog.operators.normalize import (
    normalize, normalize_access, normalize_auth, normalize_firewall, normalize_json,
    normalize_nginx_error, parse_stats,
)


def by_line(df):
    return {r.line_number: r for r in df.collect()}


def test_auth_scenario_event_types(as_lines):
    rows = normalize_auth(as_lines(auth_scenario())).collect()
    assert Counter(r.event_type for r in rows) == {
        "login_failed": 30, "login_success": 3, "session_opened": 1, "session_closed": 1, "sudo_command": 1,
    }


def test_auth_fields_and_quirks(as_lines):
    text = """Mar  1 02:14:25 host sshd[1]: Failed password for invalid user bob from 1.2.3.4 port 5 ssh2

Feb 29 01:00:00 host sshd[1]: Accepted publickey for amy from 1.2.3.4 port 5 ssh2
no header at all
Mar 11 02:15:30 host sudo: admin : TTY=pts/0 ; USER=root ; COMMAND=/bin/cat /x
Mar 11 02:15:31 host sshd[2]: Connection closed by 203.0.113.5 port 22
Mar 11 02:15:31 host sshd[2]: Received DISCONNECT from 1.1.1.1
Mar 11 02:15:32 host app: hello
Mar 11 02:15:60 host app: hello"""
    got = by_line(normalize_auth(as_lines(text)))
    assert got[1].event_time_local == datetime(2026, 3, 1, 2, 14, 25)
    assert (got[1].username, got[1].source_ip, got[1].event_type) == ("bob", "1.2.3.4", "login_failed")
    assert got[1].extra_fields == {"hostname": "host", "service": "sshd"}
    assert 2 not in got
    assert got[3].event_time is None and got[3].event_type == "login_success"
    assert (got[4].event_type, got[4].message, got[4].extra_fields) == ("unknown", "no header at all", None)
    assert got[5].extra_fields["command"] == "/bin/cat /x"
    assert (got[5].username, got[5].source_ip) == ("admin", None)
    assert (got[6].username, got[6].source_ip) == ("203.0.113.", "5")
    assert got[7].event_type == "disconnected"
    assert got[8].event_type == "auth_other"
    assert got[9].event_time is None


def test_access_fields_and_quirks(as_lines):
    text = """1.2.3.4 - bob [11/Mar/2026:02:14:01 +0530] "POST /login?x=1 HTTP/1.1" 200 89 "http://r" "UA"
1.2.3.4 - - [11/Mar/2026:02:14:01] "GET /a b HTTP/1.1" 204 -
1.2.3.4 - - [bad] "PUT /x HTTP/1.1" 200 5 "-" "-"
junk
1.2.3.4 - - [11/Mar/2026:02:14:01 nope] "GET /Admin HTTP/1.1" 200 12345678901 "-" "-" extra"""
    got = by_line(normalize_access(as_lines(text)))
    assert got[1].event_time_local == datetime(2026, 3, 11, 2, 14, 1)
    assert got[1].event_time == datetime(2026, 3, 10, 20, 44, 1)
    assert (got[1].username, got[1].event_type, got[1].user_agent) == ("bob", "authentication", "UA")
    assert got[1].message == "POST /login?x=1 -> 200"
    assert got[1].extra_fields == {"referrer": "http://r", "protocol": "HTTP/1.1"}
    assert (got[2].endpoint, got[2].extra_fields["protocol"]) == ("/a", "b HTTP/1.1")
    assert got[2].response_size is None and got[2].username is None and got[2].user_agent is None
    assert got[2].extra_fields["referrer"] == ""
    assert got[3].event_time is None and got[3].event_type == "modification"
    assert (got[4].event_type, got[4].message) == ("unparsed", "junk")
    assert got[5].event_type == "admin_access" and got[5].response_size == 12345678901
    assert got[5].event_time == datetime(2026, 3, 11, 2, 14, 1)


def test_access_scenario_all_match(as_lines):
    rows = normalize_access(as_lines(access_scenario())).collect()
    assert len(rows) == 38 and not [r for r in rows if r.event_type == "unparsed"]


def test_error_log_drops_other_lines(as_lines):
    text = """2026/01/15 10:30:00 [error] 12#0: *1 open() failed, client: 1.2.3.4, server: x
something else
2026/13/15 10:30:00 [warn] 12#0: no client"""
    got = by_line(normalize_nginx_error(as_lines(text)))
    assert sorted(got) == [1, 3]
    assert (got[1].event_type, got[1].source_ip) == ("error_error", "1.2.3.4")
    assert got[1].extra_fields == {"level": "error", "pid": "12"}
    assert got[3].event_time is None and got[3].event_type == "error_warn" and got[3].source_ip is None


def test_json_lines(as_lines):
    text = """{"ts":"2026-03-11T02:00:00+02:00","src_ip":"1.2.3.4","user":"a","status":401,"level":"WARN","msg":"x","k":{"n":1},"Bytes":7}
[1, 2, {"a": 1}]
5
{"a": 1} junk
{"USER":"b","user_name":"c","status":"nope","event":"Login","user":"d","user":"e"}
{"time":"11 Mar 2026 04:05:06","date":"x"}
{"timestamp":"Wed, 11 Mar 2026 04:05:06 GMT","description":""}
{"timestamp":"20260311","path":null,"url":"/u"}
{'a': 1}"""
    got = by_line(normalize_json(as_lines(text)))
    assert got[1].event_time == datetime(2026, 3, 11, 0, 0) and got[1].event_time_local == datetime(2026, 3, 11, 2, 0)
    assert (got[1].event_type, got[1].message, got[1].status_code, got[1].response_size) == ("warn", "x", 401, 7)
    assert got[1].extra_fields == {"k": '{"n":1}', "Bytes": "7"}
    assert (got[2].event_type, got[2].message) == ("json_array", "Array with 3 elements")
    assert got[2].extra_fields == {"array_length": "3"}
    assert [got[n].event_type for n in (3, 4, 9)] == ["unparsed"] * 3
    assert (got[5].username, got[5].event_type, got[5].status_code) == ("e", "Login", None)
    assert got[6].event_time == datetime(2026, 3, 11, 4, 5, 6) and got[6].event_type == "log_entry"
    assert got[7].event_time == datetime(2026, 3, 11, 4, 5, 6) and got[7].message.startswith('{"timestamp"')
    assert got[8].event_time == datetime(2026, 3, 11) and got[8].endpoint is None


def test_firewall_shapes(as_lines):
    text = """Mar 11 02:14:33 fw kernel: [1.0] [UFW BLOCK] IN=eth0 OUT= SRC=1.2.3.4 DST=5.6.7.8 PROTO=TCP SPT=1 DPT=22
Mar 11 02:14:33 fw pf: rule 4/0(match): block in on em0: 1.2.3.4.5 > 5.6.7.8.22
ACTION=REJECT SRC=1.2.3.4 DST=5.6.7.8 SRC=9.9.9.9
nothing here
Mar 11 02:14:33 fw kernel: [UFW REJECT] SRC=1.2.3.4
Mar 11 02:14:33 fw kernel: ACTION=DROP SRC=1.2.3.4"""
    got = by_line(normalize_firewall(as_lines(text)))
    assert got[1].event_type == "firewall_block" and got[1].destination_ip == "5.6.7.8"
    assert got[1].message == "UFW BLOCK TCP 1.2.3.4:1 -> 5.6.7.8:22"
    assert got[1].extra_fields["interface_in"] == "eth0" and got[1].extra_fields["interface_out"] is None
    assert got[2].event_type == "firewall_block" and got[2].message == "block in 1.2.3.4:5 -> 5.6.7.8:22"
    assert got[2].event_time == datetime(2026, 3, 11, 2, 14, 33)
    assert got[3].event_type == "firewall_block" and got[3].source_ip == "9.9.9.9" and got[3].event_time is None
    assert got[3].extra_fields == {"ACTION": "REJECT", "SRC": "9.9.9.9", "DST": "5.6.7.8"}
    assert got[4].event_type == "firewall_unparsed"
    assert got[5].event_type == "firewall_allow"
    assert got[6].event_type == "firewall_block" and got[6].message == "DROP  1.2.3.4: -> :"


WAF_TEXT = """timestamp,action,host,uri,httpMethod,clientIp,country,terminatingRuleId
1773194400123,BLOCK,h,"/a,b",GET,1.2.3.4,DE,"r ""x\"""
1773194400,allow,h,/c,POST,1.2.3.5,,
2026-03-11T02:00:00+05:00,Count,h,/d,GET,,US,r
x,other,h,,GET,1.1.1.1,US,r"""


def check_waf(rows):
    got = {r.line_number: r for r in rows}
    assert sorted(got) == [2, 3, 4, 5]
    assert got[2].event_time == datetime(2026, 3, 11, 2, 0) == got[3].event_time == got[4].event_time
    assert [got[n].event_type for n in (2, 3, 4, 5)] == ["waf_block", "waf_allow", "waf_count", "waf_event"]
    assert got[2].endpoint == "/a,b" and got[2].message == 'GET /a,b action=BLOCK rule=r "x"'
    assert got[2].extra_fields == {"host": "h", "country": "DE", "action": "BLOCK", "terminating_rule": 'r "x"'}
    assert got[3].message == "POST /c action=ALLOW" and got[4].source_ip is None
    assert got[5].event_time is None and got[5].endpoint is None and got[5].raw_line == ""


def test_mixed_files_in_one_pass(spark, as_lines):
    texts = {
        "auth": auth_scenario(), "access": access_scenario(), "waf": WAF_TEXT,
        "json": '{"a":1}\n{"b":2}', "fw": "SRC=1.2.3.4 DST=5.6.7.8 ACTION=DROP",
        "error": "2026/01/15 10:30:00 [error] 12#0: *1 x\nskipped", "junk": "nothing\nat all",
    }
    lines = None
    for name, text in texts.items():
        part = as_lines(text, name, name)
        lines = part if lines is None else lines.unionByName(part)
    formats = detect_format(lines)
    assert {r.job_id: r.format for r in formats.collect()} == {
        "auth": "Auth", "access": "NginxAccess", "waf": "AwsWafCsv", "json": "JSON",
        "fw": "Firewall", "error": "NginxError", "junk": "JSON",
    }
    entries = normalize(lines, formats).cache()
    assert Counter(r.job_id for r in entries.collect()) == {
        "auth": 36, "access": 38, "waf": 4, "json": 2, "fw": 1, "error": 1, "junk": 2,
    }
    check_waf(entries.filter("job_id = 'waf'").collect())
    alone = normalize_auth(lines.filter("job_id = 'auth'"))
    mixed = entries.filter("job_id = 'auth'")
    key = lambda df: sorted(map(str, df.drop("extra_fields").collect()))
    assert key(alone) == key(mixed)
    stats = {r.job_id: (r.total_lines, r.parsed_lines) for r in parse_stats(entries, lines).collect()}
    assert stats["error"] == (2, 1) and stats["junk"] == (2, 0) and stats["auth"] == (36, 36)


def test_format_hint_overrides(as_lines):
    lines = as_lines(auth_scenario())
    assert detect_format(lines, "UFW").first().format == "Firewall"
    assert detect_format(lines, "no such").first().format == "Auth"
    by_file = F.when(F.col("source_file") == lines.first().source_file, "Json").otherwise("UFW")
    assert detect_format(lines, by_file).first().format == "JSON"
