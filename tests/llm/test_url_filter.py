import compare
from verdigris.llm import url_filter as M

from compare import SMALL


def test_against_sql(spark):
    got, want = compare.both(spark, compare.connect(SMALL), M.op7_url_filter, M.ORACLE, SMALL)
    assert got == want


def test_edges(spark):
    urls = ["http://EXAMPLE.org/en/12?x", "https://a.example.org/es/", "http://x.org", "http://notexample.org/es/", "x.com/de/1", None, "", "://", "http://sub.com/de/q#f", "HTTP://É.COM/fr/", "http://com/de/", "a://b.org/?q", "http://a.org/p://q.com/de/"]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in M.filter_urls(df, M.rules_frame(spark, M.RULES)).collect()}
    assert len(got) == len(urls) + 1
    assert got[0] == ("example.org", "/en/12", "example.org/en/1", "block") == got[len(urls)]
    assert got[1][2:] == ("example.org/es/", "block")
    assert got[2] == ("x.org", "", None, "allow")
    assert got[3][2:] == ("org/", "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("com/de/", "block") and got[9][2:] == ("com/fr/", "allow") and got[10][2:] == ("com/de/", "block")
    assert got[11][2:] == ("org/", "allow")


def test_empty_frames(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = M.rules_frame(spark, M.RULES)
    assert M.filter_urls(df.limit(0), rules).count() == 0
    assert M.filter_urls(df, rules.limit(0)).first().verdict == "allow"
