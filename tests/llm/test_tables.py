"""Operations that SQL can state: against DuckDB on the tables, and on odd rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import check
from actiscope.llm import common, mixing, sharding, urls
from actiscope.llm import queries as _  # noqa: F401


@pytest.mark.parametrize("name", sorted(common.SQL))
def test_against_sql(spark, sf_dir, name):
    db = check.connect(sf_dir)
    found = db.execute(common.SQL[name])
    columns = [c[0] for c in found.description]
    df = common.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert check.comparable(df.columns, [tuple(r) for r in df.collect()]) == check.comparable(columns, found.fetchall())


def test_mixing_odd_documents(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert sorted(out.columns) == sorted({*odd_docs.columns, "copy", "shuffle_key"})
    rows = out.collect()
    for doc, n in Counter((r.doc_id, r.text) for r in rows).items():
        # Two rows share id 10; each has a draw of its own, and its copies are numbered from 0.
        copies = Counter(r.copy for r in rows if (r.doc_id, r.text) == doc)
        assert sorted(copies) == list(range(len(copies))) and copies[0] <= (2 if doc[0] == 10 else 1)
        assert all(copies[i] >= copies[i + 1] for i in range(len(copies) - 1)) and copies.total() == n
    assert mixing.mix(no_docs).count() == 0


def test_mixing_reaches_its_weights(spark):
    rows = [(i, "hot" if i < 4000 else "b" if i < 5000 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame([("hot", 1.0), ("b", 2.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix(docs, weights, total=12_000).select("source").collect())
    assert got["hot"] == pytest.approx(3000, rel=0.08) and got["b"] == pytest.approx(6000, rel=0.06) and got[None] == pytest.approx(3000, rel=0.08)
    only = mixing.mix(docs, weights.where("source = 'b'"), total=100)
    assert {r.source for r in only.collect()} == {"b"}


def test_rows_without_ids_of_their_own_are_drawn_apart(spark):
    rows = [(None, "s", i) for i in range(2000)] + [(3, "s", i) for i in range(2000)] + [(10 + i, "s", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _mix_key int").repartition(4)
    out = mixing.mix(docs).select("doc_id", F.spark_partition_id().alias("p")).collect()
    for own in (lambda i: i is None, lambda i: i == 3, lambda i: i is not None and i >= 10):
        mine = [r for r in out if own(r.doc_id)]
        assert len(mine) == pytest.approx(2000, rel=0.1)
        assert len({r.p for r in mine}) > 2
    assert mixing.mix(docs).columns == ["doc_id", "source", "_mix_key", "copy", "shuffle_key"]


def test_large_means_are_sums_of_draws(spark):
    docs = spark.createDataFrame([(i, "s") for i in range(40)], "doc_id long, source string")
    counts = Counter(r.doc_id for r in mixing.mix(docs, total=40 * 900).select("doc_id").collect())
    mean = sum(counts.values()) / 40
    assert mean == pytest.approx(900, rel=0.03) and 500 < sum((c - mean) ** 2 for c in counts.values()) / 40 < 1500


def test_shuffle_order_is_not_that_of_ids(spark, sf_dir):
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id").collect()
    rising = sum(a.doc_id < b.doc_id for a, b in zip(rows, rows[1:])) / len(rows)
    assert 0.4 < rising < 0.6


def test_shards_of_odd_documents(odd_docs, no_docs):
    rows = sharding.shards(odd_docs, limit=40_000).collect()
    want = Counter((r.doc_id, len((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_bytes) for r in rows) == want
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.n_bytes
        assert len(r.shard) == r.depth
    assert all(total[r.shard] == r.shard_bytes for r in rows)
    assert all(r.shard_bytes <= 40_000 or r.shard_bytes == r.n_bytes for r in rows if r.n_bytes)
    assert not any(a != b and b.startswith(a) for a in total for b in total)
    assert sharding.shards(no_docs).count() == 0


def test_copies_of_one_id_part(spark):
    docs = spark.createDataFrame([(7, "x" * 10)] * 60 + [(i, "y" * 10) for i in range(100, 140)], "doc_id long, text string")
    rows = sharding.shards(docs, limit=50).collect()
    assert len(rows) == 100 and max(r.shard_bytes for r in rows) <= 50 and max(r.depth for r in rows) > sharding.BITS


def test_written_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i, "text " * 20) for i in range(40)]).drop("shard")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.groupBy("shard").count().where("count > 10").count() == 0


PAGES = "page_id long, url string, html string, host int, verdict string, trust string"


def judged(spark, rows):
    df = spark.createDataFrame([(*r, 1, "v", "t") for r in rows], PAGES)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}


def test_hosts_paths_and_rules(spark):
    got = judged(spark, [
        (1, "http://WWW.Example.com/en/x?q", None), (2, "https://example.com/en/", ""), (3, "x://a.example.com/en/y#z", ""), (4, "http://a.com/fr", ""), (5, "http://a.com?x/", ""),
        (6, "http://b.net/es/1", ""), (7, "http://b.net/esp", ""), (8, None, None), (9, "no host", ""), (10, "http://", ""), (11, "http://com/", ""), (12, "http://notexample.com/en/", ""), (1, "http://WWW.Example.com/en/x?q", None),
    ])
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == got[3][2:] == ("example.com/en/", "block") and got[4][2:] == got[11][2:] == got[12][2:] == ("com/", "allow")
    assert got[5] == ("a.com", "", None, "allow") and got[6][2:] == ("net/es/", "block") and got[7][2:] == (None, "block")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    a = lambda h: f'<A class="x" href="https://{h}/p">x</A>'
    got = judged(spark, [
        (1, "http://good.com/", a("good.org") * 3 + a("GOOD.ORG") + a("other.io")), (2, "http://bad.net/fr/", ""), (3, "http://promoter.org/", a("bad.net") + a("bad.net")),
        (4, "http://good.org/", ""), (5, "http://far.org/", a("promoter.org")), (6, "http://alone.org/", ""), (7, "http://blog.promoter.org/", "<a href='/in'>x</a>"),
    ])
    assert {i: v[3] for i, v in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "block"}


def test_small_distrust_far_from_its_seed_blocks(spark):
    """Fourteen links away, where a score is about 1e-16."""
    a = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(1, "http://bad.net/fr/", ""), (2, "http://good.com/", "")]
    for level in range(1, 15):
        to = f"far{level - 1}.org" if level > 1 else "bad.net"
        rows += [(100 * level + i, f"http://far{level}.org/" if i == 0 else f"http://side{level}x{i}.org/", a(to)) for i in range(12)]
    got = judged(spark, rows)
    assert {got[100 * level][3] for level in range(1, 15)} == {"block"}
