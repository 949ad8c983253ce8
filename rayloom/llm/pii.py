"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds of the base stay whatever their score: e-mail and IP addresses, payment
cards (Luhn), international phone numbers.  The method adds, where the score
is high enough: cards and phone numbers within longer strings of digits that
failed as a whole, IBANs (mod 97), and by their context identity numbers and
phone numbers without a country code.  Everything is DataFrame functions on
one row; nothing is shuffled.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.llm.spans import blocks, cut, let, matches

#: Patterns of the base kinds: fixed values, said so that no text takes more than a pass.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A part of an IP address of at most 255, whatever its leading zeros.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: What the method looks for besides; an international number is passed over, the base has it.
OTHER = (
    r"\+[0-9][\x20().0-9-]+[0-9]|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
)
#: Within digits that failed as a card: a card in groups of four, or one unbroken; within those that failed as a phone number: a shorter one.
CARD_PART = r"[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]+"
PHONE_PART = r"\+[0-9]{1,3}(?:\x20?\([0-9]{1,4}\))?(?:[\x20.-][0-9]{2,4}){2,4}?"

#: What shows that a span is a part of something longer.
GOES_ON_BEFORE, GOES_ON_AFTER = r"[A-Za-z0-9_@#./+-]\z", r"^(?:[A-Za-z0-9_@]|[./-][A-Za-z0-9])"

#: Kinds in the order in which spans are listed, and each one's score before its context is read.
KINDS = {"email": 80, "ip": 60, "card": 80, "phone": 70, "card_part": 80, "phone_part": 70, "iban": 90, "identity": 40, "local_phone": 40}
BASE = ("email", "ip", "card", "phone")
#: Score that an added span needs, what a word nearby adds, and what one that speaks against it takes.
LEAST, MORE, LESS = 60, 30, 30
#: Characters before and after a span that are its context, as far as the next span of its kind.
BEFORE, AFTER = 48, 24

#: Words, in lower case, that speak for a kind and that speak against it.
FOR = {
    "email": "mail|e-?mail|contact|kontakt|correo|courriel|write",
    "ip": "ip|host|server|client|login|address|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|telephone|telefon|call|fax|mobile|mobil|cell|whatsapp|appel|llamar",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "identity": "ssn|social security|identity|id number|passport|national",
}
FOR |= {"card_part": FOR["card"], "phone_part": FOR["phone"], "local_phone": FOR["phone"]}
AGAINST = {k: "version|release|section|chapter" if k == "ip" else "example|sample|dummy|placeholder|test" if k in ("email", "iban") else "order|invoice|isbn|tracking|serial|part no|checksum" for k in KINDS}

SPANS = "array<struct<nth:int,start:bigint,end:bigint,score:int>>"


def _number(kind: str) -> int:
    return list(KINDS).index(kind)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.array(*[F.lit(2 * d - 9 if d > 4 else 2 * d) for d in range(10)])
    value = lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int"))
    worth = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), value)
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits, country and check digits first, leave 1 when divided by 97."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def context(before: Column, after: Column) -> Column:
    """What is read beside a span, with A-Z in lower case, as two strings."""
    lower = lambda c: F.translate(c, ascii_uppercase, ascii_lowercase)
    return F.struct(lower(F.right(before, F.lit(BEFORE))).alias("before"), lower(F.left(after, F.lit(AFTER))).alias("after"))


def _said(words: str) -> str:
    return rf"(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|\z)"


def score(kind: str, beside: Column) -> Column:
    """The kind's own score, adjusted by the words beside a span."""
    says = lambda words: beside["before"].rlike(_said(words)) | beside["after"].rlike(_said(words))
    return F.lit(KINDS[kind]) + F.when(says(FOR[kind]), F.lit(MORE)).otherwise(F.lit(0)) - F.when(says(AGAINST[kind]), F.lit(LESS)).otherwise(F.lit(0))


def _apart(before: Column, after: Column) -> Column:
    """Whether neither side goes on with letters, digits or what joins them."""
    return ~before.rlike(GOES_ON_BEFORE) & ~after.rlike(GOES_ON_AFTER)


ONE = "array<struct<nth:int,start:bigint,end:bigint,score:int,fits:boolean>>"
NESTED = "array<array<struct<nth:int,start:bigint,end:bigint,score:int,fits:boolean>>>"


def _span(kind: str, start: Column, length: Column, points: Column, fits: Column) -> Column:
    return F.struct(F.lit(_number(kind)).alias("nth"), start.alias("start"), (start + length).alias("end"), points.alias("score"), fits.alias("fits"))


def _base(text: Column, kind: str, pattern: str, fits) -> Column:
    entry = lambda start, m, before, after: let(context(before, after), lambda b: _span(kind, start, F.length(m), score(kind, b), fits(m)))
    return matches(text, pattern, entry, ONE)


def _with_parts(text: Column, kind: str, pattern: str, fits, part_kind: str, part_pattern: str, part_fits) -> Column:
    """Matches of a base kind; one that has too many digits gives the parts in it that fit by themselves, with its own context."""

    def entry(start: Column, m: Column, before: Column, after: Column) -> Column:
        def told(b: Column) -> Column:
            def part(at: Column, piece: Column, left: Column, right: Column) -> Column:
                alone = ~left.rlike(r"[0-9]\z") & ~right.rlike("^[0-9]")
                points = score(part_kind, b)
                return _span(part_kind, start + at, F.length(piece), points, alone & part_fits(piece) & (points >= LEAST))

            whole = F.array(_span(kind, start, F.length(m), score(kind, b), fits(m))).cast(ONE)
            too_long = F.length(digits(m)) > (19 if kind == "card" else 15)
            return F.when(too_long, matches(m, part_pattern, part, ONE)).otherwise(whole)

        return let(context(before, after), told)

    return F.flatten(matches(text, pattern, entry, NESTED))


def _others(text: Column) -> Column:
    def entry(start: Column, m: Column, before: Column, after: Column) -> Column:
        def told(b: Column) -> Column:
            short = F.regexp_replace(m, r"\x20[A-Z0-9]{1,3}$", "")
            whole = mod97(F.replace(m, F.lit(" "), F.lit("")))
            iban = _span("iban", start, F.when(whole, F.length(m)).otherwise(F.length(short)), score("iban", b), whole | mod97(F.replace(short, F.lit(" "), F.lit(""))))
            identity = _span("identity", start, F.length(m), score("identity", b), F.lit(True))
            phone = _span("local_phone", start, F.length(m), score("local_phone", b), F.lit(True))
            found = F.when(m.rlike("^[A-Z]"), iban).when(m.rlike("^[0-9]{3}-[0-9]{2}-"), identity).otherwise(phone)
            return let(found, lambda s: s.withField("fits", s["fits"] & ~m.startswith("+") & _apart(before, after) & (s["score"] >= LEAST)))

        return let(context(before, after), told)

    return matches(text, OTHER, entry, ONE)


def find_pii(text: Column) -> Column:
    """All spans in a text by kind, then start, as ``SPANS``; empty for null."""
    cards = lambda m: let(digits(m), lambda d: F.length(d).between(13, 19) & luhn(d))
    phones = lambda m: F.length(digits(m)).between(9, 15)
    parts = lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(f"^{BYTE}$"))
    found = F.concat(
        F.when(F.contains(text, F.lit("@")), _base(text, "email", EMAIL, lambda m: F.lit(True))).otherwise(F.array().cast(ONE)),
        _base(text, "ip", IP, parts),
        _with_parts(text, "card", CARD, cards, "card_part", CARD_PART, cards),
        _with_parts(text, "phone", PHONE, phones, "phone_part", PHONE_PART, phones),
        _others(text),
    )
    kept = F.transform(F.filter(found, lambda s: s["fits"]), lambda s: F.struct(s["nth"], s["start"], s["end"], s["score"]))
    return F.coalesce(F.array_sort(kept), F.array().cast(SPANS)).cast(SPANS)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found`` of every row of ``docs``: an array of spans with kind number, start, end (code points) and score.

    Texts of any length are searched whole, in passes linear in the text.  A
    null or empty text has no spans.  Rows are independent: repeated rows and
    null ids come out as they went in, an empty table gives no rows, and other
    columns are ignored, whatever their names.
    """
    return docs.select(F.col(id_col).alias("doc_id"), find_pii(F.col(text_col)).alias("found"))


def listed(found: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(found, lambda s: s["nth"].isin([_number(k) for k in kinds]))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["nth"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(found: Column) -> Column:
    """Scores of the spans in the order of :func:`listed`, comma-joined."""
    return F.array_join(F.transform(found, lambda s: s["score"].cast("string")), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["nth"] == _number(kind))).cast("long")


def mask_pii(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of at least ``least`` points replaced by its kind in brackets; all rows and columns stay.

    Where spans meet, the one that starts first is replaced, of those that
    start together the longest, and others that it meets go with it.  A null
    text stays null.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.transform(F.filter(find_pii(F.col(text_col)), lambda s: s["score"] >= least), lambda s: F.struct(s["start"], (-s["end"]).alias("end"), s["nth"])))
    # edges of what is kept: each span clears what starts before its end
    clear = let(spans, lambda x: F.aggregate(x, F.array(F.lit(0).cast("long")), lambda ends, s: F.array_append(ends, F.greatest(F.element_at(ends, -1), -s["end"]))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    told = docs.select(row, spans.alias("spans"), clear.alias("clear"), blocks(F.col(text_col)).alias("pieces"))
    mark = lambda s, i: F.when(s["start"] >= F.get("clear", i), F.concat(cut(F.col("pieces"), F.get("clear", i), s["start"]), F.get(names, s["nth"]))).otherwise(F.lit(""))
    end = cut(F.col("pieces"), F.element_at("clear", -1), F.length(F.col("row")[text_col]).cast("long"))
    masked = F.when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(F.concat(F.array_join(F.transform("spans", mark), ""), end))
    return told.withColumn("row", F.col("row").withField(text_col, masked)).select("row.*")


def _sql_matches(src: str, pattern: str) -> str:
    """SQL of the matches in ``src`` (``doc_id, off, t`` and two contexts of the whole, or null): what lies between two matches gives their positions."""
    return f"""SELECT doc_id, off, whole_before, whole_after, m, before, after, off + b - length(m) AS start_at FROM (
    SELECT *, (sum(length(before)) OVER w + sum(length(m)) OVER w)::BIGINT AS b FROM (
      SELECT doc_id, off, whole_before, whole_after, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS before, unnest(gaps[2:len(ms) + 1]) AS after FROM (
        SELECT *, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM {src}
      ) WHERE len(ms) > 0
    ) WINDOW w AS (PARTITION BY doc_id, off ORDER BY i)
  )"""


def _sql_luhn(number: str) -> str:
    return f"list_sum(list_transform(string_split(reverse({number}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"


def _sql_mod97(account: str) -> str:
    said = f"replace({account}, ' ', '')"
    return f"list_reduce([0::BIGINT] || list_transform(string_split(substr({said}, 5) || substr({said}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, d: (a * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1"


def _sql_span(kind: str, src: str, fits: str, length: str = "length(m)", of: str = "", added: bool = False) -> str:
    """SQL of the spans of one kind, with their score by the context in ``src``."""
    before, after = (f"translate(right({of}before, {BEFORE}), '{ascii_uppercase}', '{ascii_lowercase}')", f"translate(left({of}after, {AFTER}), '{ascii_uppercase}', '{ascii_lowercase}')")
    says = lambda words: f"regexp_matches({before}, '{_said(words)}') OR regexp_matches({after}, '{_said(words)}')"
    points = f"{KINDS[kind]} + CASE WHEN {says(FOR[kind])} THEN {MORE} ELSE 0 END - CASE WHEN {says(AGAINST[kind])} THEN {LESS} ELSE 0 END"
    told = f"SELECT doc_id, {_number(kind)} AS nth, '{kind}' AS kind, start_at, start_at + {length} AS end_at, {points} AS score FROM {src} WHERE {fits}"
    return f"SELECT * FROM ({told}) WHERE score >= {LEAST}" if added else told


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SHORT = r"regexp_replace(m, '\x20[A-Z0-9]{1,3}$', '')"
_ALONE = f"NOT regexp_matches(before, '{GOES_ON_BEFORE}') AND NOT regexp_matches(after, '{GOES_ON_AFTER}')"
_BARE = r"NOT regexp_matches(before, '[0-9]\z') AND NOT regexp_matches(after, '^[0-9]')"
_CARD = f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_sql_luhn(_DIGITS)}"
_PHONE = f"length({_DIGITS}) BETWEEN 9 AND 15"
_IDENTITY = "regexp_matches(m, '^[0-9]{3}-[0-9]{2}-')"

#: DuckDB SQL for the query's columns; the base patterns are said plainly here.
ORACLE_SQL = (
    "WITH d AS (SELECT doc_id, 0::BIGINT AS off, NULL::VARCHAR AS whole_before, NULL::VARCHAR AS whole_after, coalesce(text, '') AS t FROM documents)"
    + "".join(
        f", {name} AS MATERIALIZED (\n  {_sql_matches(src, pattern)})"
        for name, src, pattern in (
            ("emails", "d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ips", "d", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("cards", "d", r"[0-9]([\x20-]?[0-9])+"),
            ("phones", "d", PHONE),
            ("others", "d", OTHER),
            ("card_parts", f"(SELECT doc_id, start_at AS off, before AS whole_before, after AS whole_after, m AS t FROM cards WHERE length({_DIGITS}) > 19)", CARD_PART),
            ("phone_parts", f"(SELECT doc_id, start_at AS off, before AS whole_before, after AS whole_after, m AS t FROM phones WHERE length({_DIGITS}) > 15)", PHONE_PART),
        )
    )
    + ", spans AS (\n  "
    + "\n  UNION ALL ".join(
        (
            _sql_span("email", "emails", "true"),
            _sql_span("ip", "ips", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND right('00' || p, 3)::INT <= 255))"),
            _sql_span("card", "cards", _CARD),
            _sql_span("phone", "phones", _PHONE),
            _sql_span("card_part", "card_parts", f"{_CARD} AND {_BARE}", of="whole_", added=True),
            _sql_span("phone_part", "phone_parts", f"{_PHONE} AND {_BARE}", of="whole_", added=True),
            _sql_span("iban", "others", f"regexp_matches(m, '^[A-Z]') AND {_ALONE} AND ({_sql_mod97('m')} OR {_sql_mod97(_SHORT)})", f"CASE WHEN {_sql_mod97('m')} THEN length(m) ELSE length({_SHORT}) END", added=True),
            _sql_span("identity", "others", f"{_IDENTITY} AND {_ALONE}", added=True),
            _sql_span("local_phone", "others", f"NOT regexp_matches(m, '^[A-Z+]') AND NOT {_IDENTITY} AND {_ALONE}", added=True),
        )
    )
    + """
), told AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY nth, start_at) FILTER (WHERE nth < 4) AS base, string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY nth, start_at) AS spans, string_agg(score::VARCHAR, ',' ORDER BY nth, start_at) AS scores
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN told USING (doc_id)"""
)
