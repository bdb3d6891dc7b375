"""URL rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any matching URL must hold. The tokens are counted over all
URLs, and a rule is filed under the rarest of its tokens. The tokens of a URL fetch the rules filed under them; only
these candidates run their regular expressions, on the host and path of that URL. Of the rules that match, the one with
the highest rank, then the longest, then the smallest text decides.

Tokens are runs of ASCII letters and digits in lower case. A rule without tokens is filed under a token that every URL
has.

Defined results: a null URL or one without ``://`` has an empty host and path, and only rules that match the empty
string fit it; repeated rows are judged one by one; an empty table gives an empty table; other columns are not looked
at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import load
from cellweave.session import cut_lineage

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with its path.
HOST_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Words that stand as a whole host label, or part of one between hyphens, in hosts of advertising, betting and the like.
HOST_WORDS = ("ads", "adserver", "adult", "bets", "betting", "casino", "jackpot", "porn", "sexcam", "xxx")
DEFAULT = "allow"
EVERY = ""

RULES = "rule string, pattern string, tokens array<string>, rank int, verdict string"


def host_rule(host: str, path: str, verdict: str) -> tuple:
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # the last token of a path that does not end in a delimiter may go on in the URL
    whole = path if not path or not path[-1].isalnum() else re.sub(r"[0-9A-Za-z]+$", "", path)
    return host + path, pattern, tokens_of_text(host + "/" + whole), 1, verdict


def word_rule(word: str) -> tuple:
    return f"*{word}*", rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", [word], 0, "block"


def tokens_of_text(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split("[^0-9a-z]+", text.lower()) if t))


def production_rules(spark: SparkSession) -> DataFrame:
    rows = [host_rule(*r) for r in HOST_RULES] + [word_rule(w) for w in HOST_WORDS]
    return spark.createDataFrame(rows, RULES)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(site: Column) -> Column:
    """Distinct tokens, and the one that every URL has."""
    lower = F.translate(site, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.concat(F.array(F.lit(EVERY)), F.split(lower, "[^0-9a-z]+")))


def file_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with the column ``token``: the rarest of their tokens over all URLs (column ``site``).

    Only tokens that rules hold are counted, and counts combine on the map side.
    """
    held = rules.select("rule", F.explode("tokens").alias("token")).distinct()
    wanted = held.select("token").distinct()
    seen = urls.select(F.explode(url_tokens(F.col("site"))).alias("token")).join(wanted, "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        held.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return rules.join(rarest, "rule", "left").withColumn("token", F.coalesce("token", F.lit(EVERY)))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict): the deciding rule of every row, ``rule`` null if none matches."""
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    sites = rows.select(F.concat("host", "path").alias("site")).distinct()
    filed = cut_lineage(file_rules(sites, rules))
    candidates = sites.select("site", F.explode(url_tokens(F.col("site"))).alias("token")).join(filed, "token")
    matched = candidates.where(F.expr("site RLIKE pattern"))
    best = F.min_by(F.struct("rule", "verdict"), F.struct(-F.col("rank"), -F.char_length("rule"), "rule"))
    decided = matched.groupBy("site").agg(best.alias("best"))
    judged = rows.withColumn("site", F.concat("host", "path")).join(decided, "site", "left")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rule`` names host rules only; a host word decides the verdict alone."""
    judged = judge_urls(load(spark, sf_dir, "pages"), production_rules(spark))
    return judged.withColumn("rule", F.when(~F.col("rule").startswith("*"), F.col("rule")))


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
    words = "|".join(HOST_WORDS)
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(host, path, verdict) AS (VALUES {rules}),
m AS (SELECT h.r, rules.host || rules.path AS rule, rules.verdict,
             row_number() OVER (PARTITION BY h.r ORDER BY length(rules.host || rules.path) DESC) AS k
      FROM h JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path))
SELECT page_id, host, path, m.rule,
       coalesce(m.verdict, CASE WHEN regexp_matches(host, '(^|[.-])({words})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m ON h.r = m.r AND m.k = 1
"""


SQL = _sql()
