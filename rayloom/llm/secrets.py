"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text.  The hash of each candidate's value is
counted over the corpus by distinct owners and repositories: a value that many
owners or repositories hold is an example that gets copied, one that stays with
an owner looks live.  Everything is DataFrame functions; only hashes, ids and
positions are shuffled, never texts, and each distinct text is annotated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.llm.common import stored
from rayloom.llm.spans import blocks, cut, let, matches

#: Patterns of the base kinds: fixed values.  In "assign" letters of the names are in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Bare tokens, candidates of the method itself.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"

#: Order of kinds at the same start.
KINDS = ("assign", "access", "hex", "token")
#: A value held by at least so many owners, or repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: Bits that a live value's characters carry at least, by their own frequencies.
LEAST_BITS = 40.0

#: Spans of so many texts, and so many of them, are broadcast to be joined back.
BROADCAST_TEXTS, BROADCAST_ENTRIES = 50_000, 200_000

CANDIDATE = "array<struct<start:bigint,nth:int,end:bigint,value:binary,shape:boolean>>"
MATCHED = "array<struct<start:bigint,nth:int,end:bigint,value:binary,shape:boolean,fits:boolean>>"


def bits(value: Column) -> Column:
    """What the characters of a value carry, by their frequencies in it."""
    n = F.length(value).cast("double")

    def of(c: Column) -> Column:
        times = n - F.length(F.replace(value, c, F.lit("")))
        return times * (F.log2(n) - F.log2(times))

    return F.aggregate(F.transform(F.array_distinct(F.split(value, "")), of), F.lit(0.0), lambda a, x: a + x)


def looks_live(value: Column) -> Column:
    """Letters and digits that carry ``LEAST_BITS`` at least; words, fillers and repeated characters don't."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (bits(value) >= LEAST_BITS)


def found(text: Column, pattern: str, kind: str, value_group: int, least: int, more=None) -> Column:
    """Matches of ``pattern``, leftmost and non-overlapping, as ``CANDIDATE``; positions in code points.

    A match is dropped where its value, the group ``value_group``, has fewer
    than ``least`` characters.
    """

    def entry(start: Column, match: Column, before: Column, after: Column) -> Column:
        value = F.regexp_extract(match, pattern, value_group) if value_group else match
        return let(
            value,
            lambda said: F.struct(
                start.alias("start"),
                F.lit(KINDS.index(kind)).alias("nth"),
                (start + F.length(match)).alias("end"),
                F.unhex(F.sha2(said, 256)).alias("value"),
                looks_live(said).alias("shape"),
                ((F.length(said) >= least) & (more(said) if more else F.lit(True))).alias("fits"),
            ),
        )

    kept = F.filter(matches(text, pattern, entry, MATCHED), lambda e: e["fits"])
    return F.transform(kept, lambda e: F.struct(e["start"], e["nth"], e["end"], e["value"], e["shape"])).cast(CANDIDATE)


def candidates(text: Column) -> Column:
    """All candidates in a text, of all kinds; empty for null."""
    mixed = lambda said: said.rlike("[0-9].*[0-9].*[0-9]") & said.rlike("[A-Za-z]")
    kinds = (found(text, ASSIGN, "assign", 2, 6), found(text, ACCESS, "access", 0, 20), found(text, HEX, "hex", 0, 24), found(text, TOKEN, "token", 0, 16, mixed))
    return F.coalesce(F.concat(*kinds), F.array().cast(CANDIDATE))


def annotate(held: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """``tkey, found`` for each distinct text with spans: base spans, and bare tokens that look live and meet no base span; ``clear`` is where the spans before have ended.

    ``held`` has ``tkey, owner, repository, cands``, one row per document.
    Distinct (value, owner, repository) triples are counted in two steps, so
    that a value that a third of the documents hold is summed before shuffles.
    """
    some = held.filter(F.size("cands") > 0)
    triples = some.select("owner", "repository", F.explode("cands.value").alias("value")).distinct()
    owners = triples.groupBy("value", "owner").agg(F.count("*").alias("n"))
    verdict = owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    rows = some.dropDuplicates(["tkey"]).select("tkey", F.explode("cands").alias("c")).select("tkey", "c.*")
    live = F.col("shape") & (F.col("n_owners") < example_owners) & (F.col("n_repositories") < example_repositories)
    judged = rows.join(verdict, "value").withColumn("live", live).drop("shape")
    is_base = F.col("nth") < KINDS.index("token")
    before = Window.partitionBy("tkey").orderBy("start", "nth").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("tkey").orderBy(F.col("start").desc(), F.col("nth").desc()).rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(is_base, F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    kept = judged.withColumn("apart", apart).filter(is_base | (F.col("live") & F.col("apart")))
    kept = kept.withColumn("clear", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    entry = F.struct("start", "nth", "end", "live", "n_owners", "n_repositories", "value", "clear")
    return kept.groupBy("tkey").agg(F.array_sort(F.collect_list(entry)).alias("found"))


def _who(docs: DataFrame, owner: Column | None, repository: Column | None) -> tuple[Column, Column]:
    """``source``, and ``source`` with ``lang``, where nothing else is named and the columns are there; else one owner for all."""
    has = {c for c in ("source", "lang") if c in docs.columns}
    none = F.lit(None).cast("string")
    source, lang = (F.col(c).cast("string") if c in has else none for c in ("source", "lang"))
    return source if owner is None else owner, F.struct(source.alias("source"), lang.alias("lang")) if repository is None else F.struct(repository.alias("repository"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """``doc_id, found`` of every row of ``docs``: an array of spans with kind number, liveness, owner and repository counts.

    Owner and repository default to ``source`` and to ``source`` with
    ``lang``; without these columns all documents have one owner.  A null
    owner or repository counts as one of its own.  A null or empty text has no
    spans.  Texts of any length are searched whole.  Rows with the same text
    have the same spans, so repeated rows and null ids come out as they went
    in.  An empty table gives no rows; other columns are ignored.
    """
    owner, repository = _who(docs, owner, repository)
    held = stored(
        docs.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), repository.alias("repository"), F.col(text_col).alias("text"))
        .withColumn("cands", candidates(F.col("text")))
        .select("doc_id", "owner", "repository", "cands", F.when(F.size("cands") > 0, F.unhex(F.md5("text"))).alias("tkey")),
        "secrets",
    )
    spans = stored(annotate(held, example_owners, example_repositories), "spans")
    nothing = F.array().cast(spans.schema["found"].dataType)
    with_some = held.filter(F.size("cands") > 0).select("doc_id", "tkey").join(spans, "tkey", "left").select("doc_id", F.coalesce("found", nothing).alias("found"))
    without = held.filter(F.size("cands") == 0).select("doc_id", nothing.alias("found"))
    return with_some.unionByName(without)


def listed(entries: Column, only_base: bool) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    kept = F.filter(entries, lambda e: e["nth"] < KINDS.index("token")) if only_base else entries
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(kept, lambda e: F.concat_ws(":", F.get(names, e["nth"]), e["start"].cast("string"), e["end"].cast("string"))), ",")


def ownership(entries: Column) -> Column:
    """``owners:repositories:verdict`` of each span in the order of :func:`listed`, comma-joined; verdict ``live`` or ``example``."""
    verdict = lambda e: F.when(e["live"], F.lit("live")).otherwise(F.lit("example"))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["n_owners"].cast("string"), e["n_repositories"].cast("string"), verdict(e))), ",")


def count_live(entries: Column) -> Column:
    return F.size(F.filter(entries, lambda e: e["live"])).cast("long")


def count_kind(entries: Column, kind: str) -> Column:
    return F.size(F.filter(entries, lambda e: e["nth"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, entries: Column) -> Column:
    """The text with each span replaced: ``[SECRET]`` where it looks live, else ``[EXAMPLE]``; of spans that meet the first one is."""

    def told(pieces: Column) -> Column:
        mark = lambda e: F.when(e["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))
        kept = F.transform(F.filter(entries, lambda e: e["start"] >= e["clear"]), lambda e: F.concat(cut(pieces, e["clear"], e["start"]), mark(e)))
        last = F.array_max(F.transform(entries, lambda e: e["end"]))
        return F.concat(F.array_join(kept, ""), cut(pieces, last, F.length(text).cast("long")))

    return let(blocks(text), told)


def redact_secrets(
    docs: DataFrame,
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """``docs`` with every secret replaced; all rows and columns stay.

    Texts are searched once.  The spans of the few texts that have any are
    joined back by the text's digest: broadcast where they are few, else by
    shuffle.  A text is cut in blocks, in time linear in its length and spans.
    Owners, nulls, repeated rows and empty tables are as in
    :func:`scan_secrets`; a null text stays null.  Columns may have any names.
    """
    tkey = F.unhex(F.md5(F.col(text_col)))
    owner, repository = _who(docs, owner, repository)
    scanned = docs.select(tkey.alias("tkey"), owner.alias("owner"), repository.alias("repository"), candidates(F.col(text_col)).alias("cands"))
    held = stored(scanned.filter(F.size("cands") > 0), "secrets")
    spans = stored(annotate(held, example_owners, example_repositories), "spans")
    few = spans.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("entries")).first()
    if few.texts <= BROADCAST_TEXTS and few.entries <= BROADCAST_ENTRIES:  # at most 25 MB
        spans = F.broadcast(spans)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    met = docs.select(row, tkey.alias("tkey")).join(spans, "tkey", "left")
    text = F.when(F.col("found").isNull(), F.col("row")[text_col]).otherwise(redacted(F.col("row")[text_col], F.col("found")))
    return met.withColumn("row", F.col("row").withField(text_col, text)).select("row.*")


def _matches(kind: str, pattern: str, group: int, least: int, more: str = "true") -> str:
    """SQL of the matches of one kind: between two matches lies what the text is split into."""
    said = "regexp_extract(m, p, %d)" % group if group else "m"
    return f"""SELECT doc_id, source, lang, {KINDS.index(kind)} AS nth, '{kind}' AS kind, b - length(m) AS start_at, b AS end_at, {said} AS said FROM (
    SELECT *, '{pattern.replace("'", "''")}' AS p, (sum(length(gap)) OVER w + sum(length(m)) OVER w)::BIGINT AS b FROM (
      SELECT doc_id, source, lang, unnest(range(1, len(whole) + 1)) AS i, unnest(whole) AS m, unnest(gaps[1:len(whole)]) AS gap FROM (
        SELECT doc_id, source, lang, regexp_extract_all(t, '{pattern.replace("'", "''")}') AS whole, regexp_split_to_array(t, '{pattern.replace("'", "''")}') AS gaps FROM d
      ) WHERE len(whole) > 0
    ) WINDOW w AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE length({said}) >= {least} AND {more.replace("said", said)}"""


#: DuckDB SQL for the query's columns; positions come from the lengths of what lies between matches.
ORACLE_SQL = (
    "WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents), cands AS (\n  "
    + "\n  UNION ALL ".join(
        (
            _matches("assign", ASSIGN, 2, 6),
            _matches("access", ACCESS, 0, 20),
            _matches("hex", "[0-9a-f]{24,}", 0, 24),
            _matches("token", "[A-Za-z0-9+/_=-]{16,}", 0, 16, "regexp_matches(said, '[0-9].*[0-9].*[0-9]') AND regexp_matches(said, '[A-Za-z]')"),
        )
    )
    + f"""
), owned AS (
  SELECT said, count(DISTINCT coalesce('1' || source, '2')) AS n_owners, count(DISTINCT coalesce('1' || source, '2') || chr(1) || coalesce('1' || lang, '2')) AS n_repositories FROM cands GROUP BY said
), shapes AS (
  SELECT said, sum(n * (log2(length(said)) - log2(n))) AS bits
  FROM (SELECT said, c, length(said) - length(replace(said, c, '')) AS n FROM (SELECT said, unnest(list_distinct(string_split(said, ''))) AS c FROM (SELECT DISTINCT said FROM cands)) WHERE c <> '') GROUP BY said
), judged AS (
  SELECT c.*, n_owners, n_repositories, regexp_matches(said, '[0-9]') AND regexp_matches(said, '[A-Za-z]') AND bits >= {LEAST_BITS} AND n_owners < {EXAMPLE_OWNERS} AND n_repositories < {EXAMPLE_REPOSITORIES} AS live
  FROM cands c JOIN owned USING (said) JOIN shapes USING (said)
), kept AS (
  SELECT * FROM judged a WHERE nth < 3 OR (live AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.doc_id = a.doc_id AND b.nth < 3 AND b.start_at < a.end_at AND a.start_at < b.end_at))
), told AS (
  SELECT doc_id, count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access, count(*) FILTER (WHERE nth = 2) AS n_hex, count(*) FILTER (WHERE live) AS n_live,
    string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, nth) FILTER (WHERE nth < 3) AS base,
    string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, nth) AS spans,
    string_agg(n_owners || ':' || n_repositories || ':' || CASE WHEN live THEN 'live' ELSE 'example' END, ',' ORDER BY start_at, nth) AS ownership
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(ownership, '') AS ownership
FROM d LEFT JOIN told USING (doc_id)"""
)
