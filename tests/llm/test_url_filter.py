import duckdb
import pytest

from varloom.llm.url_filter import SQL, judge_urls, op9_url_filter

URLS = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "x://notexample.org/es/1", "https://example.org", "https://example.org?x/es/", "https://u@b.COM:80/de/1#/", "a://b://c/d", "https://q.com/fr/1", "https://É.com/de/ü", "https://z.net//a//b/", "https://z.net/a\nb?c"]


def test_hosts_paths_and_longest_rules(spark):
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()}
    seen = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert seen[0] == seen[1] == seen[2] == ("", "", None, "allow")
    assert seen[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert seen[4][2:] == ("example.org/en/1", "block") and seen[5][2:] == ("org/", "allow")
    assert seen[6] == ("notexample.org", "/es/1", "org/", "allow")
    assert seen[7] == ("example.org", "", None, "allow") and seen[8] == ("example.org", "", None, "allow")
    assert seen[9] == ("u@b.com:80", "/de/1", None, "allow") and seen[10][:2] == ("b:", "//c/d")
    assert seen[11][2:] == ("com/fr/", "allow") and seen[12] == ("É.com", "/de/ü", "com/de/", "block")
    assert seen[14] == ("z.net", "/a\nb", None, "allow")


def test_templates_learn_from_rules_and_merge(spark):
    rules = (("block", "s.net/bad/1"), ("allow", "s.net/good/1"))
    rows = [(f"http://s.net/{d}/{a}{i}", d) for d in ("bad", "good") for a in (1, 2) for i in range(40)] + [("http://t.net/bad/2", "t")]
    got = judge_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string"), rules=rules).collect()
    for r in got:
        assert r.verdict == ("block" if r.host == "s.net" and r.path.startswith("/bad/") else "allow"), r
        assert r.template == (f"{r.path.split('/')[1]}/*" if r.host == "s.net" else "*")


def test_literals_are_chosen_below_their_parent(spark):
    """Many sections of one host, each a hundredth of its pages, one of them blocked; and a deep path."""
    rules = (("block", "s.net/s7/1"), ("allow", "s.net/s8/1"))
    deep = "/".join(["deep"] * 60)
    urls = [f"http://s.net/s{k}/{i % 2}{i}" for k in range(100) for i in range(40)] + [f"http://s.net/{deep}/{i}" for i in range(30)] + [f"http://s.net/rare{i}/s7/1" for i in range(30)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    for r in got:
        assert r.verdict == ("block" if r.path.startswith("/s7/") else "allow"), r
        assert r.template == ("deep/" * 60 + "*" if r.path.startswith("/deep") else "*/s7/1" if r.path.startswith("/rare") else f"{r.path.split('/')[1]}/*"), r


def test_a_few_labels_block_no_large_branch(spark):
    rules = (("block", "s.net/a/bad"),)
    urls = [f"http://s.net/a/bad{i}" for i in range(13)] + [f"http://s.net/a/x{i}" for i in range(2000)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules)
    assert got.where("verdict = 'block'").count() == 13


def test_templates_are_shared_by_hosts(spark):
    """What is blocked on labelled hosts is blocked at the same template of a host without labels."""
    rules = (("block", "org/win"), ("allow", "org/"))
    urls = [f"http://h{h}.{d}/{s}/{i}" for d in ("org", "net") for h in range(4) for s in ("win", "news") for i in range(20)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    assert all(r.verdict == ("block" if "/win/" in r.path else "allow") for r in got)
    assert sum(r.rule is None and r.verdict == "block" for r in got) == 80


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        judge_urls(spark.range(1).selectExpr("id page_id", "'' url"), rules=(("allow", "a/"),) * 1001)


def test_sql_agrees_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    urls = URLS + [f"https://s{i % 5}.{'org' if i % 3 else 'net'}/{('win', 'news', 'x' + str(i))[i % 3]}/{i % 4}/{i}" for i in range(300)] + [f"https://h{i % 7}.example.{'org' if i % 2 else 'net'}/es/{i}" for i in range(200)] + [f"https://s{i % 3}.com/{'de' if i % 2 else 'en'}/{i}/{'x' * (i % 5)}" for i in range(300)] + ["https://h.com/" + "/".join("abcdefghijkl")] * 30
    spark.createDataFrame([(i if i % 50 else None, u, "c") for i, u in enumerate(urls * 2)], "page_id long, url string, template string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = op9_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cols = ", ".join(got.columns)
    want = con.execute(f"select {cols} from ({SQL['op9_url_filter']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
