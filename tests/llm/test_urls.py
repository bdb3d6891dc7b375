from compare import compare, connect

from cellweave.llm import urls as U


def judged(spark, urls, rules=None):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = U.production_rules(spark) if rules is None else spark.createDataFrame(rules, U.RULES)
    return {r.page_id: tuple(r)[1:] for r in U.judge_urls(df, rules).collect()}


def test_hosts_paths_and_longest_rule(spark):
    got = judged(spark, [
        "https://a.Example.NET/en/1?x=/de/", "http://example.net/de/", "http://example.net", "https://m.example.com/de/x#y", "https://example.com/De/x",
        "http://x.org/fr/", "http://notnet/", "http://www.ads.example.com/", "http://free-bets.example.org/en/", "http://bets.x.org/fr/a", None, "no scheme/net/",
        "ftp://deep.er.net/x://y/", "http:///path", "http://badnet.com/en/", "http://example.net/en",
    ])
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        1: ("example.net", "/de/", "net/", "block"),
        2: ("example.net", "", None, "allow"),
        3: ("m.example.com", "/de/x", "example.com/de/", "block"),
        4: ("example.com", "/De/x", None, "allow"),
        5: ("x.org", "/fr/", "org/fr/", "allow"),
        6: ("notnet", "/", None, "allow"),
        7: ("www.ads.example.com", "/", "*ads*", "block"),
        8: ("free-bets.example.org", "/en/", "*bets*", "block"),
        9: ("bets.x.org", "/fr/a", "org/fr/", "allow"),
        10: ("", "", None, "allow"),
        11: ("", "", None, "allow"),
        12: ("deep.er.net", "/x://y/", "net/", "block"),
        13: ("", "/path", None, "allow"),
        14: ("badnet.com", "/en/", None, "allow"),
        15: ("example.net", "/en", "net/", "block"),
    }


def test_rules_without_tokens_and_ties(spark):
    rules = [("any", ".", [], 0, "block"), ("aa", "^x", ["x"], 1, "allow"), ("bb", "^x", ["x"], 1, "block")]
    got = judged(spark, ["http://x/", "http://y/", None], rules)
    assert [got[i][2:] for i in range(3)] == [("aa", "allow"), ("any", "block"), (None, "allow")]


def test_rules_are_filed_under_their_rarest_token(spark):
    sites = spark.createDataFrame([("a.com/x",), ("b.com/x",), ("b.com/y",)], "site string")
    rules = spark.createDataFrame([("r", "", ["com", "b", "x"], 0, "block"), ("s", "", ["com", "zz"], 0, "block"), ("t", "", [], 0, "block")], U.RULES)
    assert {r.rule: r.token for r in U.file_rules(sites, rules).collect()} == {"r": "b", "s": "zz", "t": ""}


def test_pages_against_sql_and_empty_table(spark, sf_dir):
    assert compare(U.query(spark, sf_dir), connect(sf_dir), U.SQL)[1] == []
    assert U.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), U.production_rules(spark)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "http://a.net/", "h"), (None, "http://a.net/", "h"), (1, None, "s")], "page_id bigint, url string, site string")
    got = sorted((r.page_id or 0, r.verdict) for r in U.judge_urls(df, U.production_rules(spark)).collect())
    assert got == [(0, "block"), (0, "block"), (1, "allow")]
