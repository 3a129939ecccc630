"""Files: listing, encodings, tables, sinks, whole runs, and the command line."""

import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexmill.__main__ import main, parser
from lexmill.config import Settings
from lexmill.plans import job
from lexmill.sources import encoding, files, sinks, tables
from lexmill.streaming import counts

LINES = ["天下太平万物安宁", "苹果香蕉橘子葡萄", "天地玄黄宇宙洪荒", "琴棋书画诗酒花茶", "金木水火土阴阳风", "刀枪剑戟斧钺钩叉", "山川河流湖泊江海", "鸟兽虫鱼草木石玉"]
ALL = Settings(max_len=4, min_freq=5, pmi=0.0, entropy=0.0, position=0.0)


def write(path, text, enc="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(enc))
    return str(path)


def words(path):
    head, *rest = open(path, encoding="utf-8").read().splitlines()
    assert head == "word\tfreq\tpmi\tentropy\tpos_prob\tpos"
    return {x.split("\t")[0]: x.split("\t")[1:] for x in rest}


def test_listing(spark, tmp_path):
    for name in ("b.txt", "sub/a.MD", "_x.txt", ".h.csv", "n.data", "p.parquet"):
        write(tmp_path / name, "x")
    assert [os.path.relpath(f.path, tmp_path) for f in files.list_files(spark, str(tmp_path))] == [".h.csv", "_x.txt", "b.txt", "sub/a.MD"]
    assert [f.path for f in files.list_files(spark, str(tmp_path / "n.data"))] == [str(tmp_path / "n.data")]
    (tmp_path / "none").mkdir()
    assert files.list_files(spark, str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "missing"))


def test_detection():
    many = "\n".join(LINES * 10)
    assert encoding.detect([many.encode()]) == encoding.detect([b""]) == encoding.detect([b"abc"]) == encoding.detect(["短".encode()]) == "utf-8"
    assert encoding.detect([many.encode("gbk")]) in ("gb18030", "gbk")
    assert encoding.detect(["\n".join(["臺灣繁體中文測試資料", "學習電腦語言處理"] * 60).encode("big5")]) == "big5"
    damaged = bytearray(many.encode())
    damaged[1000:1003] = b"\xff\xfe\x88"
    assert encoding.detect([bytes(damaged)]) == "utf-8"
    assert encoding.detect([bytes(range(256)) * 4])
    assert encoding.decode_cut_utf8("天地".encode()[2:-1]) == ""
    assert encoding.decode_cut_utf8("天地玄".encode()[1:-2]) == "地"
    with pytest.raises(UnicodeDecodeError):
        encoding.decode_cut_utf8(b"abc\xffdefgh")


def test_samples(spark, tmp_path):
    data = random.Random(1).randbytes(300 << 10)
    path = write(tmp_path / "r.txt", data)
    (file,) = files.list_files(spark, path)
    got = files.samples(spark, file)
    assert [len(x) for x in got] == [65536] * 3 and got[0] == data[:65536] and got[2] == data[-65536:] and got[1] in data
    assert files.samples(spark, files.TextFile(path, 300 << 10), 1 << 20) == [data]
    assert files.has_long_lines(spark, files.TextFile(write(tmp_path / "l.txt", "天。" * 500), 3000), least=1000, n=100)
    assert not files.has_long_lines(spark, files.TextFile(write(tmp_path / "s.txt", "天\n" * 500), 2000), least=1000, n=100)


def test_lines_of_all_kinds_of_files(spark, tmp_path):
    """Encodings, hidden names and huge lines give the tokens of their texts."""
    body = "天下太平，万物安宁。\r\n山川河流\n"
    made = {"a.txt": "utf-8", "b.txt": "gbk", "c.txt": "big5", "_hidden.txt": "utf-8", "d.txt": "utf-16"}
    for name, enc in made.items():
        write(tmp_path / name, body if enc != "big5" else "天下太平，山河。\n", enc)
    listed = [files.TextFile(str(tmp_path / n), os.path.getsize(tmp_path / n), e) for n, e in made.items()]
    listed.append(files.TextFile(write(tmp_path / "e.txt", body * 3), 9, "utf-8", True))
    listed.append(files.TextFile(write(tmp_path / "f.txt", body * 3, "gbk"), 9, "gbk", True))
    listed.append(files.TextFile(write(tmp_path / "g.txt", ""), 0))
    from lexmill.operators.tokens import tokens

    got = tokens(files.read_lines(spark, listed), "value", ("path",)).groupBy("path").agg(F.sort_array(F.collect_list("tok")).alias("t")).collect()
    got = {os.path.basename(r.path): r.t for r in got}
    want = sorted(["天下太平", "万物安宁", "山川河流"])
    assert got["a.txt"] == got["b.txt"] == got["_hidden.txt"] == got["d.txt"] == want
    assert got["c.txt"] == sorted(["天下太平", "山河"]) and got["e.txt"] == got["f.txt"] == sorted(want * 3) and "g.txt" not in got
    assert files.read_lines(spark, []).count() == 0


def test_streamed_cuts_no_token(spark, tmp_path):
    r = random.Random(2)
    text = "".join(r.choice("天地玄黄宇宙，a") for _ in range(5000)) + "洪荒" * 3000
    path = write(tmp_path / "x.txt", text, "gb18030")
    rows = files.streamed(spark.createDataFrame([(path, "gb18030")], "path string, encoding string"), block=700).collect()
    assert "".join(r.value for r in rows) == text and len(rows) > 3
    assert all(not "一" <= r.value[-1] <= "龥" for r in rows[:-1])


def test_tables(spark, tmp_path):
    path = write(tmp_path / "pos.txt", "中\t0.1\t0.3\t0.6\n\nbad\n国\tx\t0.1\t0.2\n国\t0.9\t0.4\t0.4\n 国\t0.2\t0.4\t0.4 \n")
    assert {tuple(r) for r in tables.position_table(spark, path).collect()} == {("中", 0.1, 0.3, 0.6), ("国", 0.2, 0.4, 0.4)}
    assert tables.position_table(spark, str(tmp_path / "none")).isEmpty() and tables.position_table(spark, None).isEmpty()
    assert {tuple(r) for r in tables.tag_table(spark, write(tmp_path / "tags", "天地\tn\nx\n天地\tv\n")).collect()} == {("天地", "v")}
    assert [tuple(r) for r in tables.read_statistics(spark, write(tmp_path / "s", "word_only\na\t1\t2\t3\ngood\t42\t1.5\nbad\tx\t1\n")).collect()] == [("good", 42, 1.5)]
    assert {tuple(r) for r in tables.read_ngrams(spark, write(tmp_path / "g", "天\t地\n\t地\n天\n天地\t\n")).collect()} == {("天", "地", 1), ("天地", "", 1)}


def test_sinks(spark, tmp_path):
    stats = spark.createDataFrame([("玄", 2, 0.5), ("天", 3, 1.23456789)], "word string, freq long, entropy double")
    assert sinks.write_statistics(stats, str(tmp_path / "s.tsv")) == 2
    assert open(tmp_path / "s.tsv").read() == "天\t3\t1.234568\n玄\t2\t0.500000\n"
    assert {tuple(r) for r in tables.read_statistics(spark, str(tmp_path / "s.tsv")).collect()} == {("玄", 2, 0.5), ("天", 3, 1.234568)}
    grams = spark.createDataFrame([("天", "$", "地", 2)], "word string, l string, r string, c long")
    sinks.write_ngrams(grams, str(tmp_path / "g"))
    assert [tuple(r) for r in tables.read_ngrams(spark, str(tmp_path / "g")).collect()] == [("天", "地", 1)] * 2
    assert sinks.default_output(spark, write(tmp_path / "in.txt", "x"), date(2024, 3, 1)) == str(tmp_path / "in_20240301_words_sort.data")
    assert sinks.default_output(spark, str(tmp_path), date(2024, 3, 1)) == str(tmp_path / f"{tmp_path.name}_20240301_words_sort.data")


def test_counted_ngrams_take_a_line_each(spark, tmp_path):
    """However often a pair occurs; lines that don't parse are passed over."""
    grams = spark.createDataFrame([("天", "地", 3_000_000_000), ("天地", "$", 1), ("地", "", 2)], "word string, ctx string, c long")
    sinks.write_ngrams(grams, str(tmp_path / "g"), "ctx", counted=True)
    lines = [x for p in (tmp_path / "g").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines) == sorted(["天\t地\t3000000000", "天地\t$\t1", "地\t\t2"])
    assert sorted(map(tuple, tables.read_ngrams(spark, str(tmp_path / "g"), counted=True).collect())) == sorted(map(tuple, grams.collect()))
    assert [tuple(r) for r in tables.read_ngrams(spark, write(tmp_path / "o", "天\t地\n\t地\t2\n天\t地\tx\n天\t\t\t5\n天\n"), counted=True).collect()] == [("天", "\t", 5)]


def test_query_of_ngram_files_writes_no_line_for_each_occurrence(spark, sf_dir, monkeypatch):
    from lexmill.plans import queries as core

    seen, real = [], sinks.write_ngrams
    monkeypatch.setattr(sinks, "write_ngrams", lambda grams, folder, *a, **k: (real(grams, folder, *a, **k), seen.append(folder)))
    got = core.ngram_files(spark, sf_dir)
    assert spark.read.text(seen[0]).count() == got.count()


def test_statistics_are_made_once_when_written(spark, tmp_path):
    """The number of rows is counted as they are written, by tables that are empty too."""
    made = spark.sparkContext.accumulator(0)

    def one(rows):
        made.add(1)
        yield from rows

    source = spark.range(3, numPartitions=1).selectExpr("cast(id as string) as word", "id as freq", "0.5D as entropy")
    stats = source.mapInPandas(one, source.schema).repartition(2)  # the shuffle is read by the sort's sample and the sort
    assert sinks.write_statistics(stats, str(tmp_path / "s")) == 3 and made.value == 1
    assert sinks.write_statistics(stats.where("false"), str(tmp_path / "e")) == 0 and open(tmp_path / "e").read() == ""


def test_run_utf8_gbk_and_empty(spark, tmp_path):
    got = words(job.run(write(tmp_path / "u" / "a.txt", "\n".join(LINES * 30)), settings=ALL, spark=spark))
    assert len(got) == 144 and got["天下"] == ["30", "5.000000", "0.000000", "0.000000", "x"]
    assert len(words(job.run(write(tmp_path / "g" / "a.txt", "\n".join(LINES[:2] * 30), "gbk"), settings=ALL, spark=spark))) == 36
    (tmp_path / "e").mkdir()
    assert words(job.run(str(tmp_path / "e"), settings=ALL, spark=spark)) == {}
    write(tmp_path / "ascii" / "a.txt", "hello world\n" * 100)
    assert words(job.run(str(tmp_path / "ascii"), str(tmp_path / "o.data"), ALL, spark=spark)) == {}
    assert len(os.listdir(tmp_path / "u")) == 2  # the corpus and its lexicon, nothing else


def test_run_mixed_folder(spark, tmp_path):
    write(tmp_path / "one.txt", LINES[1] * 100)
    write(tmp_path / "many.txt", (LINES[5] + "\n") * 60)
    got = words(job.run(str(tmp_path), str(tmp_path / "o.data"), Settings(max_len=2, min_freq=5, pmi=0.0, entropy=0.0, position=0.0), spark=spark))
    assert len(got) == 15 and got["苹果"][:2] == ["100", "3.678072"] and got["刀枪"][:2] == ["60", "4.415037"]


def test_resume_gives_the_same_file(spark, tmp_path, monkeypatch):
    path, work = write(tmp_path / "c" / "a.txt", "\n".join(LINES[:4] * 60)), str(tmp_path / "work")
    clean = open(job.run(path, str(tmp_path / "clean"), ALL, spark=spark), "rb").read()
    real = job.write_lexicon

    def fails(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(job, "write_lexicon", fails)
    with pytest.raises(KeyboardInterrupt):
        job.run(path, str(tmp_path / "again"), ALL, work_dir=work, spark=spark)
    assert os.path.exists(f"{work}/statistics/_SUCCESS")
    monkeypatch.setattr(job, "write_lexicon", real)
    monkeypatch.setattr(job, "read_lines", fails)  # the finished stages aren't made again
    assert open(job.run(path, str(tmp_path / "again"), ALL, work_dir=work, spark=spark), "rb").read() == clean
    assert not os.path.exists(f"{work}/statistics") and clean.count(b"\n") == 73


def test_changed_input_and_force_start_over(spark, tmp_path):
    path, work = write(tmp_path / "c" / "a.txt", "天下太平万物安宁\n" * 80), tmp_path / "work"
    s = Settings(max_len=2, min_freq=5, pmi=0.0, entropy=0.0, position=0.0)
    stages = job.Stages(spark, str(work))
    stale = spark.createDataFrame([("旧词", 99, 1.0, 1.0)], "word string, freq long, right_entropy double, left_entropy double")
    for more in ({"force": True}, {}):
        stages.made("statistics", stale)
        if more:
            stages.sign(job.signature_of(path, files.list_files(spark, path), s))
        else:
            stages.sign({"input": "other"})
        write(work / "own.txt", "kept")
        got = words(job.run(path, str(tmp_path / "o"), s, work_dir=str(work), spark=spark, **more))
        assert len(got) == 7 and "旧词" not in got and (work / "own.txt").exists()


def test_room_is_checked(spark, tmp_path):
    with pytest.raises(RuntimeError, match="has room for"):
        job.check_room(str(tmp_path), 1 << 60)


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "a.txt", "天下太平万物安宁\n" * 80)
    assert main([path, "-o", str(tmp_path / "o"), "-l", "2", "--min-freq", "5", "--pmi-threshold", "0", "--entropy-threshold", "0", "--pos-threshold", "0", "-q"]) == 0
    assert len(words(tmp_path / "o")) == 7 and str(tmp_path / "o") in capsys.readouterr().out
    for bad in (["-l", "33"], ["-l", "1"], ["-m", "0"], ["-w", "0"], ["--min-freq", "0"], ["--temp-dir", "/no/such"]):
        with pytest.raises(SystemExit) as e:
            parser().parse_args([path, *bad])
        assert e.value.code and bad[0].lstrip("-") in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main([str(tmp_path / "missing")])


def test_counts_of_a_stream(spark, tmp_path):
    """Two rounds of files give the statistics of all of them at once."""
    s = Settings(max_len=3, min_freq=2)
    folder = tmp_path / "in"
    for k in range(2):
        write(folder / f"{k}.txt", "\n".join(LINES[k::2] * 5))
        stream = spark.readStream.schema("value string").text(str(folder))
        counts.counted(stream, str(tmp_path / "counts"), str(tmp_path / "check"), "value", s).awaitTermination()
    from lexmill.plans.lexicon import word_statistics

    want = word_statistics(spark.read.text(str(folder)), "value", s)
    assert sorted(map(tuple, counts.current(spark, str(tmp_path / "counts"), s).collect())) == sorted(map(tuple, want.collect()))
