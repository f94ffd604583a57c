"""URL filters: rules first, then trust and distrust spread over the links between hosts.

A rule names a host and the start of a path; the longest that fits decides. Pages without a
rule are judged by their host: hosts with allowed pages are seeds of trust, hosts with blocked
pages seeds of distrust, as much as they have such pages. Trust follows links (personalised
PageRank), distrust goes back from a host to those that link to it. Hosts of one site (a host
and the one it is a subdomain of) link to each other. A host whose distrust outweighs its trust
by a factor is blocked, any other allowed.

Only DataFrame functions are used. Links are counted per pair of hosts before anything is
joined, seeds per host, so a host with a third of all pages is one row of the graph.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule and
are allowed; null html has no links; repeated rows count as often as they come; ties between
rules of one length go to the first in the list; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import pinned
from plumbline.session import shared_folder

DAMPING = 0.85
STEPS = 8
FACTOR = 2.5
_SURE = 1e-9  # sums in another order differ by less
_HREF = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # with its slash

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """``rule("block", "example.org/es/")``"""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.char_length(rest) + F.lit(4))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.contains(url, F.lit("://")), host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.char_length(rest) + F.lit(4))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise(F.lit(""))


def rule_index(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Place in ``rules`` of the longest one that fits, or null. For lists of a readable size."""
    found = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k].text), -k)):
        own = rules[k]
        inside = (host == own.host) | F.endswith(host, F.lit(f".{own.host}"))
        found = F.when(inside & F.startswith(path, F.lit(own.path)), F.lit(k)).otherwise(found)
    return found


def _picked(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index) if values else F.lit(None).cast("string")


def parsed(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, decided, html."""
    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    rows = pages.select(
        pages["page_id"].alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        pages["html"].cast("string").alias("html"),
    ).withColumn("_rule", rule_index(F.col("host"), F.col("path"), rules))
    return rows.select(
        "page_id",
        "host",
        "path",
        _picked(F.col("_rule"), [r.text for r in rules]).alias("rule"),
        _picked(F.col("_rule"), [r.verdict for r in rules]).alias("decided"),
        "html",
    )


def host_links(rows: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, and between a host and its parent."""
    found = rows.select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("url")
    )
    # Links inside a host carry nothing; only urls that name a host matter.
    url = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("x:"), "url")).otherwise(F.col("url"))
    named = found.select("src", host_of(url).alias("dst")).where("src <> '' AND dst <> ''")
    hosts = rows.where("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    # A host, its parent, the parent's parent, down to the last two labels.
    levels = hosts.where(F.size(labels) > 2).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels) - 2),
                lambda k: F.struct(
                    F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("a"),
                    F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("b"),
                ),
            )
        ).alias("pair")
    )
    sites = levels.select("pair.a", "pair.b").distinct()
    sites = sites.unionAll(sites.select("b", "a")).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).cast("bigint").alias("n")
    )
    links = named.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return links.unionAll(sites).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, steps: int = STEPS) -> DataFrame:
    """host, trust, distrust after some steps from seeds (host, trust, distrust)."""
    out = links.groupBy("src").agg(F.sum("n").alias("n_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("n_in"))
    along = links.join(out, "src").select(
        F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("n_out")).alias("t"), F.lit(0.0).alias("d")
    )
    back = links.join(into, "dst").select(
        F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("n") / F.col("n_in")).alias("d")
    )
    moves = along.unionAll(back).groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    moves = pinned(moves, "moves")
    shared_folder(links.sparkSession)
    start = seeds.select("host", (F.col("trust") * (1 - DAMPING)).alias("trust"), (F.col("distrust") * (1 - DAMPING)).alias("distrust"))
    state = start
    for step in range(1, steps + 1):
        sent = state.join(moves, state["host"] == moves["a"]).select(
            F.col("b").alias("host"),
            (F.col("trust") * F.col("t") * DAMPING).alias("trust"),
            (F.col("distrust") * F.col("d") * DAMPING).alias("distrust"),
        )
        state = start.unionAll(sent).groupBy("host").agg(
            F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")
        )
        if step % 4 == 0:
            state = state.checkpoint()
    return state


def url_filter(pages: DataFrame, rules: list[Rule], steps: int = STEPS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = parsed(pages, rules)
    seeds = rows.where("decided IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("decided") == "allow").cast("double").alias("trust"),
        F.count_if(F.col("decided") == "block").cast("double").alias("distrust"),
    )
    links = pinned(host_links(rows), "host_links")
    scores = propagate(pinned(seeds, "seeds"), links, steps)
    blocked = scores.where(F.col("distrust") > F.col("trust") * FACTOR + _SURE)
    blocked = blocked.select("host", F.lit("block").alias("spread"))
    judged = rows.drop("html").join(blocked, "host", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("decided", "spread", F.lit("allow")).alias("verdict"),
    )


def oracle(rules: list[Rule], steps: int = STEPS) -> str:
    """The same in SQL, one step of the spread after another."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase

    def host(url: str) -> str:
        return (
            f"CASE WHEN contains({url}, '://') THEN translate(regexp_extract("
            f"substr({url}, strpos({url}, '://') + 3), '^([^/?#]*)', 1), '{upper}', '{lower}') ELSE '' END"
        )

    picks = " ".join(
        f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') "
        f"THEN '{r.verdict} {r.text}'"
        for r in sorted(rules, key=lambda r: -len(r.text))
    )
    parts = [
        f"""rows AS (
  SELECT page_id, html, {host("coalesce(url, '')")} AS host,
    CASE WHEN contains(url, '://') THEN
      regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)""",
        f"""judged AS (
  SELECT page_id, html, host, path,
    split_part(pick, ' ', 1) AS decided, split_part(pick, ' ', 2) AS rule
  FROM (SELECT *, CASE {picks} END AS pick FROM rows))""",
        """seeds AS (
  SELECT host, 0.15 * count(*) FILTER (decided = 'allow') AS trust,
    0.15 * count(*) FILTER (decided = 'block') AS distrust
  FROM judged WHERE decided IS NOT NULL GROUP BY host)""",
        r"""found AS (
  SELECT host AS src, unnest(regexp_extract_all(html,
    '(?i)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) AS url FROM rows)""",
        f"""named AS (
  SELECT src, {host("u")} AS dst
  FROM (SELECT src, CASE WHEN prefix(url, '//') THEN 'x:' || url ELSE url END AS u FROM found))""",
        """hosts AS (SELECT DISTINCT string_split(host, '.') AS l FROM rows WHERE host <> '')""",
        """pairs AS (
  SELECT DISTINCT array_to_string(l[k:], '.') AS a, array_to_string(l[k + 1:], '.') AS b
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM hosts WHERE len(l) > 2))""",
        """links AS (
  SELECT src, dst, sum(n) AS n FROM (
    SELECT src, dst, count(*) AS n FROM named WHERE src <> '' AND dst <> '' AND src <> dst
      GROUP BY src, dst
    UNION ALL SELECT a, b, 1 FROM pairs UNION ALL SELECT b, a, 1 FROM pairs)
  GROUP BY src, dst)""",
        """moves AS (
  SELECT a, b, sum(t) AS t, sum(d) AS d FROM (
    SELECT src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS t, 0.0 AS d FROM links
    UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM links)
  GROUP BY a, b)""",
        "s0 AS (SELECT * FROM seeds)",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""s{k} AS MATERIALIZED (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
    SELECT * FROM seeds UNION ALL
    SELECT m.b, 0.85 * s.trust * m.t, 0.85 * s.distrust * m.d
    FROM s{k - 1} s JOIN moves m ON m.a = s.host)
  GROUP BY host)"""
        )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT j.page_id, j.host, j.path, nullif(j.rule, '') AS rule,
  CASE WHEN j.decided IN ('allow', 'block') THEN j.decided
    WHEN s.distrust > s.trust * {FACTOR} + {_SURE} THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN s{steps} s ON s.host = j.host
"""
    )
