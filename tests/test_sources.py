from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, rest


def test_json_lines_skip_broken_ones_and_read_gzip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "retry_count": 2}\n{"id": \n\n{"id": "2"}\n')
    with gzip.open(tmp_path / "a.jsonl.1.gz", "wt") as f:
        f.write('{"id": "3"}\n')
    got = files.session_logs(spark, str(tmp_path), files.QUEUE_SCHEMA)
    assert sorted(r.id for r in got.collect()) == ["1", "2", "3"]


def test_markdown_front_matter(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text('---\ntitle: "A title"\ntags: [X, y, x]\ntype: rule\n---\n# Head\nbody\n')
    (tmp_path / "b.md").write_text("# Head B\ntext\n")
    (tmp_path / "c.md").write_text("---\ntags:\n  - One\n  - two\n---\nplain\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.markdown(spark, str(tmp_path)).collect()}
    assert (got["a.md"].title, got["a.md"].tags, got["a.md"].kind) == ("A title", ["x", "y"], "rule")
    assert got["b.md"].title == "Head B" and got["c.md"].tags == ["one", "two"] and got["c.md"].title == "c"


def test_handoffs_and_templates_and_projects(spark, tmp_path):
    h, t, p = tmp_path / "h", tmp_path / "t.json", tmp_path / "p"
    h.mkdir()
    p.mkdir()
    (h / "session-12-2026-01-05.md").write_text("x")
    (h / "note.md").write_text("on 2026-02-03 we")
    got = {r.path.rsplit("/", 1)[1]: (str(r.date), r.number) for r in files.handoffs(spark, str(h)).collect()}
    assert got == {"session-12-2026-01-05.md": ("2026-01-05", 12), "note.md": ("2026-02-03", None)}
    t.write_text('[{"content": "use short functions", "domain": "Python", "tags": ["A", "a "]}, {"content": "x", "domain": "d"}]')
    assert [(r.domain, r.tags) for r in files.templates(spark, str(t)).collect()] == [("python", ["a"])]
    (p / "a.yaml").write_text("k: 1")
    (p / "a.yml").write_text("k: 2")
    assert [(r.project, r.text) for r in files.projects(spark, str(p)).collect()] == [("a", "k: 1")]


def test_backup_is_verified(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    files.backup(df, str(tmp_path / "b"), "v1")
    assert files.restore(spark, str(tmp_path / "b"), "v1").count() == 50
    spark.range(1).withColumn("x", F.col("id")).write.mode("append").parquet(str(tmp_path / "b" / "v1" / "data"))
    with pytest.raises(ValueError):
        files.restore(spark, str(tmp_path / "b"), "v1")


def test_audit_names_contents_by_hash(spark, tmp_path):
    files.append_audit(spark.createDataFrame([("p", "secret")], "id string, content string"), str(tmp_path / "a"))
    got = spark.read.json(str(tmp_path / "a"))
    assert sorted(got.columns) == ["content_hash", "id"] and len(got.first().content_hash) == 16


def test_paged_sources(spark):
    def fake(url, headers):
        """Two pages by link, two by token, three by offset."""
        if url.startswith("link"):
            return 200, ({"Link": '<link?page=2>; rel="next"', "ETag": "t"} if "page" not in url else {}), [{"n": 1}] if "page" not in url else [{"n": 2}]
        if url.startswith("token"):
            return (200, {}, {"issues": [{"n": 4}]}) if "nextPageToken" in url else (200, {}, {"issues": [{"n": 3}], "nextPageToken": "z"})
        start = int(url.split("startAt=")[1].split("&")[0])
        return 200, {}, {"comments": [{"n": 5 + start}], "total": 3}

    got = rest.rest_table(spark, fake, [("a", "link", "link"), ("b", "token?q", "token"), ("c", "offset", "offset")]).collect()
    assert sorted((r.resource, r.raw) for r in got) == [("a", '{"n": 1}'), ("a", '{"n": 2}'), ("b", '{"n": 3}'), ("b", '{"n": 4}'), ("c", '{"n": 5}'), ("c", '{"n": 6}'), ("c", '{"n": 7}')]
    assert list(rest.by_link(lambda u, h: (304, {}, None), "link", {"link": "t"})) == []
    with pytest.raises(RuntimeError):
        list(rest.by_link(lambda u, h: (500, {}, None), "link"))
