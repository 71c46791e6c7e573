import random

import pytest

from test_normalize import WAF_TEXT, check_waf
from wardlog.operators.normalize_waf import normalize_waf
from wardlog.sources import csv_records, lines
from wardlog.sources.lines import list_log_files, read_log_lines
from wardlog.sources.waf_csv import read_waf_csv


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(5)
    want = {}
    for name in ("a.log", "b.LOG", "skip.bin"):
        lines = [" " * rng.randint(0, 3) if rng.random() < 0.2 else f" {name} {i} {'x' * rng.randint(0, 60)}\t" for i in range(3000)]
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
        if not name.endswith("bin"):
            want |= {(name, i): line.strip() for i, line in enumerate(lines, 1) if line.strip()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = {
            (r.source_file.split("/")[-1], r.line_number): r.raw_line
            for r in read_log_lines(spark, str(tmp_path)).collect()
        }
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want


def test_bad_bytes_are_replaced_and_lines_cut(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"ok\r\n\xff\xfe bad\n\nlast")
    rows = read_log_lines(spark, str(tmp_path), "j", max_lines=3).collect()
    assert [(r.job_id, r.line_number, r.raw_line) for r in rows] == [("j", 1, "ok"), ("j", 2, "�� bad")]


def test_listing_knows_extensions(spark, tmp_path):
    for name in ("a.log", "b.csv", "c.exe", "d.JSONL"):
        (tmp_path / name).write_text("x")
    assert sorted(r.extension for r in list_log_files(spark, str(tmp_path)).collect()) == ["csv", "jsonl", "log"]


def test_waf_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text(WAF_TEXT)
    check_waf(normalize_waf(read_waf_csv(spark, str(tmp_path))).collect())


def test_waf_csv_with_line_break_in_a_cell(spark, tmp_path):
    (tmp_path / "w.csv").write_text('timestamp,uri,clientIp,httpMethod\n1,"/a\n/b",1.1.1.1,GET\n2,/c,1.1.1.2,GET\n')
    rows = normalize_waf(read_waf_csv(spark, str(tmp_path), "j")).collect()
    assert sorted((r.line_number, r.endpoint) for r in rows) == [(2, "/a\n/b"), (3, "/c")]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def random_export(rng, rows, name):
    """CSV text with quotes, commas, doubled quotes, line breaks and blank lines inside and between records."""
    def cell():
        plain = rng.choice(["", "a", "/x y", "5 pipes", " lead", "tail ", "é中", "it's"])
        odd = rng.choice(['say ""hi""', "a,b", "two\nlines", "\n", "x\n\n\ny", '""', '","', "\r\nend", "a\n  \nb"])
        return f'"{odd}"' if rng.random() < 0.4 else f'"{plain}"' if rng.random() < 0.3 else plain

    out = ["timestamp,action,uri,clientIp"]
    for i in range(rows):
        out.append(",".join([f"{name}{i}", *(cell() for _ in range(3))]))
        out += [""] * (rng.random() < 0.1) + ["   "] * (rng.random() < 0.05)
    return rng.choice(["\n", "\r\n"]).join(out) + "\n"


@pytest.mark.parametrize("bound", [10**9, 0])
def test_records_are_those_of_the_csv_reader(spark, tmp_path, small_splits, monkeypatch, bound):
    """Random exports, cut into splits of 700 bytes within their records, against the reader that takes a file whole."""
    for module, names in ((csv_records, ("BROADCAST_SLOTS", "BROADCAST_EVENTS")), (lines, ("BROADCAST_SPLITS",))):
        for name in names:
            monkeypatch.setattr(module, name, bound)
    monkeypatch.setattr(csv_records, "SLOT_LINES", 7)
    rng = random.Random(3)
    for k, rows in enumerate((0, 1, 40, 150, 300)):
        (tmp_path / f"f{k}.csv").write_bytes(random_export(rng, rows, f"f{k}-").encode())
    (tmp_path / "plain.csv").write_text("timestamp,action,uri,clientIp\n" + "".join(f"p{i},BLOCK,/p{i},1.1.1.1\n" for i in range(200)))
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
    text = lambda c: None if c is None else c.replace("\r\n", "\n")
    want = sorted((tuple(map(text, r)) for r in whole.collect() if r[0] is None or r[0].strip()), key=repr)
    read = read_waf_csv(spark, str(tmp_path), "j")
    found = read.collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == want
    numbers = {}
    for r in found:
        numbers.setdefault(r.source_file, {})[r.line_number] = int(r.timestamp.split("-")[-1].lstrip("p"))
    assert all(seen == {n: n - 2 for n in range(2, len(seen) + 2)} for seen in numbers.values())
    if bound:
        assert "f4.csv" not in read._jdf.queryExecution().toString() and read.rdd.getNumPartitions() > 5


def test_quotes_that_do_not_open_a_cell(spark, tmp_path, small_splits):
    """A quote within a plain cell is text, and one that is never closed leaves the lines after it alone."""
    head = "timestamp,action,uri"
    inch = [f'{i},5" pipe,/p{i}' for i in range(60)]
    (tmp_path / "inch.csv").write_text("\n".join([head, *inch[:30], '30,ALLOW,"/a\n/b"', *inch[31:]]))
    (tmp_path / "open.csv").write_text("\n".join([head, '0,ALLOW,/a', '1,ALLOW,"/b', *[f"{i},ALLOW,/c" for i in range(2, 40)]]))
    rows = read_waf_csv(spark, str(tmp_path), "j").collect()
    got = {(r.source_file.rsplit("/", 1)[1][:4], r.line_number): (r.timestamp, r.uri) for r in rows}
    assert got[("inch", 32)] == ("30", "/a\n/b")
    assert all(got[("inch", i + 2)] == (str(i), f"/p{i}") for i in range(60) if i != 30)
    assert all(got[("open", i + 2)] == (str(i), "/c") for i in range(2, 40)) and len(got) == 100
