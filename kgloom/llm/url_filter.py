"""Operator 7: URL filter by rules and, where none fits, by a tree of path templates. DataFrame and SQL only.

Rules are (verdict, "host/path"): a rule fits its host and all subdomains if the url's path starts with the rule's path;
the longest wins. Pages that a rule judges are the labelled ones for the rest:

* per host, paths become templates from the root down. A segment is a wildcard if it holds a digit or is over 24
  characters long (an extension stays), or, on all levels but the last, if it has over 20 siblings and under a twentieth
  of its parent's pages. Levels beyond ``depth`` (3, or the deepest path's if None) become one ``**``.
* siblings whose labelled share of blocked pages does not differ from their parent's (1.96 standard errors), or that
  have no labels, are merged into one branch.
* a template's purity is its labelled share of blocked pages, smoothed by its host's share, that by the share of the same template on
  all hosts, and that by the share of all labelled pages (each prior weighs 4 pages). Purity from 0.5 on is blocked.

The steps are SQL that Spark and DuckDB both run. Counts are aggregated in each task before they are shuffled; joins have
one row for each key on their right side, so a hot host can be split by adaptive execution.

Nulls and edge cases: a null url, or one without ``://``, has empty host and path and is judged as the host ''; a null
page_id stays null; repeated rows are returned each and count each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import checkpoint, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    path = slash + path
    return f"((host = {_text(host)} OR right(host, {len(host) + 1}) = {_text('.' + host)}) AND left(path, {len(path)}) = {_text(path)})"


def _shape(part: int) -> str:
    seg = f"split_part(path, '/', {part + 1})"
    return f"CASE WHEN slashes < {part} THEN NULL WHEN regexp_extract({seg}, '([0-9])', 1) <> '' OR length({seg}) > 24 THEN concat('*', regexp_extract({seg}, '([.][A-Za-z]{{1,5}})$', 1)) ELSE {seg} END"


#: Names of the steps of the levels of a tree.
LEVELS = ("one", "two", "three", "four", "five", "six", "seven", "eight")


def steps(rules=RULES, id_col: str = "page_id", url_col: str = "url", depth: int = 3) -> list[tuple[str, str]]:
    """(name, SQL) of each step; the first reads ``pages``. The tree has ``depth`` levels."""
    if depth < 2:
        raise ValueError("a tree has two levels at least")
    rest = ", ".join(f"p.s{i}" for i in range(2, depth + 1))
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {_fits(r)} THEN {_text(r)}" for _, r in longest) + " END" if rules else "CAST(NULL AS VARCHAR(10))"
    label = "CASE rule " + " ".join(f"WHEN {_text(r)} THEN {int(v == 'block')}" for v, r in longest) + " END" if rules else "CAST(NULL AS INT)"
    level = lambda at, seg, before, after: [
        (f"{at}_kids", f"SELECT host, t, {seg} AS seg, count(*) AS n FROM {before} WHERE {seg} IS NOT NULL GROUP BY host, t, {seg}"),
        (f"{at}_all", f"SELECT host, t, sum(n) AS total, count(*) AS kids FROM {at}_kids GROUP BY host, t"),
        (f"{at}_kept", f"SELECT k.host, k.t, k.seg FROM {at}_kids k JOIN {at}_all a ON k.host = a.host AND k.t = a.t WHERE left(k.seg, 1) <> '*' AND (a.kids <= 20 OR k.n * 20 >= a.total)"),
        (after, f"SELECT p.id, p.host, p.path, p.rule, p.label, {rest}, p.slashes, concat(p.t, CASE WHEN p.{seg} IS NULL THEN '' WHEN left(p.{seg}, 1) = '*' OR k.seg IS NOT NULL THEN concat('/', p.{seg}) ELSE '/*' END) AS t FROM {before} p LEFT JOIN {at}_kept k ON p.host = k.host AND p.t = k.t AND p.{seg} = k.seg"),
    ]
    share = lambda b, m, prior: f"({b} + 4.0e0 * {prior}) / ({m} + 4.0e0)"
    return [
        ("urls", f"SELECT CAST({id_col} AS BIGINT) AS id, coalesce({url_col}, '') AS url FROM pages"),
        ("cut", f"SELECT id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls"),
        ("ruled", f"SELECT id, host, path, {rule} AS rule, length(path) - length(replace(path, '/', '')) AS slashes FROM cut"),
        ("level0", f"SELECT id, host, path, rule, {label} AS label, slashes, {', '.join(f'{_shape(i)} AS s{i}' for i in range(1, depth + 1))}, '' AS t FROM ruled"),
        *(step for i in range(1, depth) for step in level(LEVELS[i - 1] if i <= len(LEVELS) else f"deep{i}", f"s{i}", f"level{i - 1}", f"level{i}")),
        ("shaped", f"SELECT id, host, path, rule, label, concat(t, CASE WHEN s{depth} IS NULL THEN '' ELSE concat('/', s{depth}) END, CASE WHEN slashes > {depth} THEN '/**' ELSE '' END) AS t FROM level{depth - 1}"),
        ("templates", "SELECT host, t, regexp_replace(t, '/[^/]*$', '') AS parent, count(label) AS m, coalesce(sum(label), 0) AS b FROM shaped GROUP BY host, t"),
        ("parents", "SELECT host, parent, sum(m) AS pm, sum(b) AS pb FROM templates GROUP BY host, parent"),
        ("branches", "SELECT t.host, t.t, t.m, t.b, CASE WHEN t.m = 0 OR abs(t.b * 1.0e0 / t.m - p.pb * 1.0e0 / p.pm) <= 1.96e0 * sqrt((p.pb + 1.0e0) * (p.pm - p.pb + 1.0e0) / ((p.pm + 2.0e0) * (p.pm + 2.0e0)) / t.m) THEN concat(t.parent, '/~') ELSE t.t END AS branch FROM templates t JOIN parents p ON t.host = p.host AND t.parent = p.parent"),
        ("merged", "SELECT host, branch, sum(m) AS bm, sum(b) AS bb FROM branches GROUP BY host, branch"),
        ("hosts", "SELECT host, sum(m) AS hm, sum(b) AS hb FROM templates GROUP BY host"),
        ("shapes", "SELECT t, sum(m) AS tm, sum(b) AS tb FROM templates GROUP BY t"),
        ("everywhere", "SELECT (coalesce(sum(b), 0) + 1.0e0) / (coalesce(sum(m), 0) + 2.0e0) AS rate FROM templates"),
        ("judged", f"SELECT x.host, x.t, x.branch, {share('y.bb', 'y.bm', share('h.hb', 'h.hm', share('s.tb', 's.tm', '(SELECT rate FROM everywhere)')))} AS purity FROM branches x JOIN merged y ON x.host = y.host AND x.branch = y.branch JOIN hosts h ON x.host = h.host JOIN shapes s ON x.t = s.t"),
        ("verdicts", "SELECT p.id AS page_id, p.host, p.path, p.rule, CASE WHEN p.label = 1 THEN 'block' WHEN p.label = 0 THEN 'allow' WHEN j.purity >= 0.5e0 THEN 'block' ELSE 'allow' END AS verdict, j.branch AS template FROM shaped p JOIN judged j ON p.host = j.host AND p.t = j.t"),
    ]


def url_verdicts(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", depth: int | None = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row of pages. Without a depth the tree is as deep as the paths."""
    import uuid

    spark, mark = pages.sparkSession, uuid.uuid4().hex[:12]
    if depth is None:
        path = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)
        depth = max(2, pages.agg(F.max(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))).head()[0] or 0)
    names = ["pages", *(n for n, _ in steps(rules, depth=depth))]
    pages.select(id_col, url_col).createOrReplaceTempView(f"pages_{mark}")
    found = pages
    kept = ("level0", "shaped", "templates", *(f"level{i}" for i in range(3, depth)))
    for name, text in steps(rules, id_col, url_col, depth):
        for other in sorted(names, key=len, reverse=True):
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {other} ", f"{word} {other}_{mark} ").replace(f"{word} {other})", f"{word} {other}_{mark})")
                if text.endswith(f"{word} {other}"):
                    text += f"_{mark}"
        found = spark.sql(text)
        if name in kept:
            found = checkpoint(found)
        found.createOrReplaceTempView(f"{name}_{mark}")
    for name in names:
        spark.catalog.dropTempView(f"{name}_{mark}")
    return found


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in steps()[:-1]) + "\n" + steps()[-1][1]}
