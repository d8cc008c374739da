"""Secret scans in DataFrame functions only, with corpus-wide ownership frequency.

Base spans are pattern matches. The method's own spans are long mixed tokens that
no pattern catches: every candidate value is hashed, the hashes are counted by
distinct repositories and owners over the whole corpus, and a value that stays with
few owners and looks live becomes a span, while one copied among many owners is an
example. Spans are code point positions, end exclusive.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, plain

#: kind -> (pattern, the group that must have ``least`` characters)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20), "hex": (r"([0-9a-f]{24,})", 1, 24)}
KINDS = [*BASE, "owned"]
#: Candidates of the ownership count: unbroken runs of 20 or more token characters.
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    rows = F.arrays_zip(whole.alias("w"), value.alias("g"), between.alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["b"]
        end = begin + F.char_length(row["w"])
        made = F.struct(begin.alias("start"), end.alias("end"), row["g"].alias("value"))
        # The piece after the last match has no match of its own.
        return F.when(row["w"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(made)).alias("out")))

    found = F.aggregate(rows, start, step, lambda acc: acc["out"])
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _long(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.char_length(s["value"]) >= least)


def of_kind(spans: Column, kind: str) -> Column:
    """How many of ``spans`` are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _live(value: Column) -> Column:
    """Mixed upper case, lower case and digits in at least ten different characters."""
    classes = [value.rlike("[A-Z]"), value.rlike("[a-z]"), value.rlike("[0-9].*[0-9]")]
    return functools.reduce(operator.and_, classes) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan(docs: DataFrame, repository: str, owner: str, most_owners: int = 2, most_repositories: int = 50, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_spans`` (array of start, rank, end, kind, value), ``_live`` and
    ``_examples`` (numbers of spans with owner-specific and with widely copied values).

    Every pattern match is a span. A candidate apart from them becomes one, of kind
    ``owned``, if it looks live and its value stays with ``most_owners`` distinct
    owners and ``most_repositories`` distinct repositories or fewer in all rows; any
    other value is an example. Null owners and repositories count as the empty name,
    null texts as empty. Names that begin with ``_`` are used inside and must not be
    columns of ``docs``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[_kind(_long(_matches(text, p, g), least), kind) for kind, (p, g, least) in BASE.items()])
    apart = lambda c: ~F.exists("_base", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
    own = F.filter(_matches(text, CANDIDATE, 1), lambda c: _live(c["value"]) & apart(c))
    marked = docs.withColumn("_base", base).withColumn("_key", F.md5(text)).withColumn("_all", F.concat("_base", _kind(own, "owned")))
    held = cut(marked.filter(F.size("_all") > 0).select("_key", F.col(repository).cast("string").alias("_repo"), F.col(owner).cast("string").alias("_owner"), "_all"))
    counted = ownership(held.select("_repo", "_owner", F.explode("_all.value").alias("_value")))
    named = held.select("_key", "_all").distinct().select("_key", F.explode("_all").alias("_span")).withColumn("_hash", F.sha2("_span.value", 256))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = named.join(counted, "_hash").withColumn("_is", live).groupBy("_key").agg(
        F.collect_list(F.when(F.col("_is") & (F.col("_span.kind") == "owned"), F.col("_span"))).alias("_owned"),
        F.count_if("_is").alias("_live"), F.count_if(~F.col("_is") & (F.col("_span.kind") != "owned")).alias("_examples"),
    )
    out = marked.drop("_all").join(judged, "_key", "left")
    spans = F.when(F.col("_owned").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", "_owned")))
    return out.select(*docs.columns, "_base", spans.alias("_spans"), F.coalesce("_live", F.lit(0)).alias("_live"), F.coalesce("_examples", F.lit(0)).alias("_examples"))


def ownership(values: DataFrame) -> DataFrame:
    """``(_hash, repositories, owners)`` of ``values(_repo, _owner, _value)``, counted
    from distinct rows upwards so that a common value meets each shuffle as few rows."""
    each = values.select(F.sha2("_value", 256).alias("_hash"), F.coalesce("_owner", F.lit("")).alias("_owner"), F.coalesce("_repo", F.lit("")).alias("_repo"))
    by_repo = each.groupBy("_hash", "_owner", "_repo").agg(F.count("*").alias("_n"))
    by_owner = by_repo.groupBy("_hash", "_owner").agg(F.count("*").alias("_repos"))
    return by_owner.groupBy("_hash").agg(F.sum("_repos").alias("repositories"), F.count("*").alias("owners"))


def redact(docs: DataFrame, repository: str, owner: str, mark: str = "<secret>", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans give
    one mark. ``length_col``, if given, becomes the new text's number of characters.
    Rows and the other columns stay as they are."""
    own, columns = plain(docs)
    name = dict(zip(columns, own.columns, strict=True))
    found = scan(own, name[repository], name[owner], text_col=name[text_col])
    text = F.col(name[text_col])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))

    clean = F.aggregate(F.array_sort("_spans"), start, step, rest)
    out = found.withColumn(name[text_col], F.when(F.size("_spans") > 0, clean).otherwise(text))
    if length_col:
        out = out.withColumn(name[length_col], F.char_length(text).cast(docs.schema[length_col].dataType))
    return out.select(*own.columns).toDF(*columns)


# --- the same in SQL -----------------------------------------------------------------


def _sql_matches(pattern: str, group: int, kind: str, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, t, source, s + 1 AS i, w[s + 1] AS w, g[s + 1] AS value, {KINDS.index(kind)} AS rank, '{kind}' AS kind,
        list_sum(list_transform(b[1:s + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:s], lambda x: length(x))), 0) AS st
      FROM (SELECT *, unnest(range(len(w))) AS s FROM (
        SELECT doc_id, t, source, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {group}) AS g, string_split_regex(t, {p}) AS b FROM d))
      WHERE length(g[s + 1]) >= {least}"""


def oracle(most_owners: int = 2, most_repositories: int = 50) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, t, source, kind, rank, value, st, st + length(w) AS en FROM ({_sql_matches(p, g, k, n)})" for k, (p, g, n) in BASE.items())
    own = _sql_matches(CANDIDATE, 1, "owned", 0)
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    base AS ({parts}),
    cand AS (SELECT * FROM (SELECT doc_id, t, source, kind, rank, value, st, st + length(w) AS en FROM ({own})) c
      WHERE regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9].*[0-9]')
        AND len(list_distinct(string_split(value, ''))) >= 10
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.st < c.en AND b.en > c.st)),
    spans AS (SELECT * FROM base UNION ALL SELECT * FROM cand),
    owned AS (SELECT value, count(DISTINCT source) <= {most_owners} AND count(DISTINCT (source, doc_id)) <= {most_repositories} AS live FROM spans GROUP BY value),
    judged AS (SELECT s.*, o.live FROM spans s JOIN owned o USING (value)),
    own AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) FILTER (kind <> 'owned') AS base,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) FILTER (kind <> 'owned' OR live) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind <> 'owned') AS n_examples
      FROM judged GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
    FROM d LEFT JOIN own USING (doc_id)"""
