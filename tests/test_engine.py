import math

import duckdb
import pytest

import __spark_entry__ as entry
from inkwell.operators import attachments, metadata, search, voice
from inkwell.plans import fixtures
from inkwell.sources import readers, sinks
from inkwell.streaming import stream

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in sql:
        df = queries[name](spark, SF)
        r = con.execute(sql[name])
        names = [d[0] for d in r.description]
        assert sorted(df.columns) == sorted(names), name
        order = [names.index(c) for c in df.columns]
        want = sorted(tuple(norm(row[i]) for i in order) for row in r.fetchall())
        assert sorted(tuple(norm(v) for v in row) for row in df.collect()) == want, name


def test_entry_and_rest_run(spark):
    assert entry.entry(spark).count() > 0
    for name in ("gate_matrix", "gate_rejections", "diverse_beam", "recursive_rollback", "beam_depths", "proposals", "targeted_outcomes", "voice_by_lang", "md_blocks", "ops_validate"):
        assert entry.queries()[name](spark, SF).count() > 0, name


def test_attachment_states(spark):
    got = {r.path: r.state for r in attachments.states(fixtures.files(spark)).collect()}
    assert got == {n: s for n, _, s in fixtures.file_bytes()}
    cleaned = {r.path: r.cleaned for r in attachments.clean(fixtures.files(spark)).collect()}
    assert b"Author" not in cleaned["author.png"] and bytes(cleaned["plain.png"]) == dict((n, b) for n, b, _ in fixtures.file_bytes())["plain.png"]
    assert b"Copyright" in cleaned["software.png"] and b"Claude" not in cleaned["software.png"] and b"c2pa" in cleaned["manifest.png"]
    assert cleaned["broken.png"] is None and cleaned["noise.bin"] is None
    assert b"Ann" not in cleaned["exif.jpg"] and cleaned["exif.jpg"].endswith(b"\x12\xff\0\x34\xff\xd9") and bytes(cleaned["plain.jpg"]) == dict((n, b) for n, b, _ in fixtures.file_bytes())["plain.jpg"]
    assert len(cleaned["info.pdf"]) == 58 and b"OpenAI" not in cleaned["info.pdf"] and b"Ann" not in cleaned["author.docx"]


def test_proposals(spark):
    df = spark.createDataFrame([("Although it rained, we went out.",), ("one; two",), ("It ended. However, we stayed.",), ("a — b",), ("x",)], "phrase string")
    got = {r.phrase: r.replacement for r in search.proposals(df, {"x": "y"}).collect()}
    assert got == {"Although it rained, we went out.": "We went out, although it rained.", "one; two": "one. Two", "It ended. However, we stayed.": "It ended; however, we stayed.", "a — b": "a: b", "x": "y"}


def test_voice(spark):
    text = "I can't say. You know it's fine! We go on; and on.\n\nA second one here, with more words in it than before, so that it counts."
    df = spark.createDataFrame([("a", text)], "source string, text string")
    r = voice.describe(voice.style(df, "source")).first()
    assert (r.n_sentences, r.n_paragraphs) == (4, 2) and r.first_rate > 0 and r.second_rate > 0 and r.contraction_rate > 0
    assert not any(c.isdigit() for c in r.description)


def test_front_matter(spark):
    df = spark.createDataFrame([(1, "---\nauthor: A\ntitle: t\n---\nbody"), (2, "no front"), (3, "---\nmodel: gemini\n---\nrest")], "doc_id long, text string")
    assert {r.doc_id: r.clean for r in metadata.clean_front(df).collect()} == {1: "---\ntitle: t\n---\nbody", 2: "no front", 3: "rest"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# é")
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF-")
    got = {r.path.rsplit("/", 1)[-1]: (r.media_type, r.text, r.problem) for r in readers.read_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": ("text/markdown", "# é", None), "b.txt": ("text/plain", None, "not UTF-8"), "c.pdf": ("unsupported", None, "unsupported type")}
    df = spark.range(5)
    out = str(tmp_path / "out")
    sinks.write_verified(df, out)
    with pytest.raises(sinks.RefusedWrite):
        sinks.write_verified(df, out)
    with pytest.raises(sinks.RefusedWrite):
        sinks.write_verified(df, out, sources=(out,), overwrite=True)
    sinks.save_run(df, str(tmp_path / "runs"), "r1")
    assert sinks.list_runs(spark, str(tmp_path / "runs")) == ["r1"] and sinks.sibling("x.txt") == "x.clean.txt"


def test_stream_equals_batch(spark, tmp_path):
    docs = fixtures.inserted(spark.read.parquet(f"{SF}/documents.parquet"))
    docs.write.parquet(str(tmp_path / "docs"))
    batch = spark.read.parquet(str(tmp_path / "docs"))
    from inkwell.operators import inspect

    want = sorted(map(tuple, inspect.findings(batch).select("doc_id", "offset", "kind").collect()))
    s = stream.carriers(stream.read_documents(spark, str(tmp_path / "docs"), batch._jdf.schema().toDDL()))
    got = stream.run_once(s.select("doc_id", "offset", "kind"), "carriers", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == want


def test_config_and_reports(spark):
    from inkwell.operators import diffs, scorers
    from inkwell.plans import config, report

    got = config.resolve({"cli": {"unicode.policy": "report"}, "project": config.load_toml('[unicode]\npolicy = "aggressive"\nform = "none"')})
    assert (got["unicode.policy"].value, got["unicode.policy"].layer, got["unicode.form"].layer, got["rewrite.hops"].layer) == ("report", "cli", "project", "default")
    for bad in ("[a]\napi_key = 'x'", "= 1"):
        with pytest.raises(config.ConfigError):
            config.load_toml(bad)
    for url in ("http://example.org", "https://example.org", "https://u:p@ok.org"):
        with pytest.raises(config.ConfigError):
            config.check_endpoint(url, frozenset(("ok.org",)))
    assert config.check_endpoint("https://ok.org/v1", frozenset(("ok.org",))) and config.literal_lock("a.b") == "a\\.b"
    df = spark.createDataFrame([(1, "ab\u200bcd 42%\nx")], "doc_id long, text string")
    r = report.inspection(df).first().report
    assert '"findings":{"zero_width":1}' in r and '"unit":1' in r and '"removable":1' in r
    assert '"n_ops":1' in report.edits(df).first().report and report.prompt(df).first().prompt.endswith("x")
    pair = spark.createDataFrame([(1, "a\nb\n", "a\nc\n")], "doc_id long, before string, after string")
    assert "-b\n+c\n" in diffs.unified(pair).first().diff
    from pyspark.sql import functions as F

    assert tuple(df.select(diffs.line_column(F.col("text"), F.lit(11)).alias("p")).first().p) == (2, 2)
    first = scorers.score(df, lambda: len, "length", "1")
    again = scorers.score(df, lambda: (lambda t: -1.0), "length", "1", first.select("key", "score", "token_count"))
    assert [x.score for x in again.collect()] == [11.0]
    assert scorers.evidence(first, "d", "surrogate", 20.0).first().below
