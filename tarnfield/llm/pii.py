"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

All of it is expressions of Spark SQL. Matches of a pattern come from
regexp_extract_all; splitting the text by the same pattern gives what stands between
them, so running sums of both lengths are the matches' code-point offsets.

Kinds of the base: email, ip (parts up to 255), card (16 to 19 digits, Luhn), phone
(8 to 15 digits); their matches are leftmost and don't overlap, failing ones are
dropped without another try. The method adds iban (its country's length, mod-97) and ssn. A
context word in the ``CONTEXT_CHARS`` code points before or after a span raises its score;
an added span needs ``MIN_SCORE``, which an ssn reaches only so. Base spans stay whatever
their score.

The patterns are possessive where no other way to match exists, and start only
where a run of their characters starts or the last match ended: scanning is linear in
the length of a run and no repetition recurses, so long runs don't overflow the stack.

Defined cases: a null or empty text has no spans (redacted, it stays as it is); equal
rows and rows with a null or repeated doc_id stay rows of their own; an empty table gives
no rows; very long texts are scanned whole; spans of different kinds may overlap and are
all listed, by kind, then start. Columns other than the text go through redaction as they
were, whatever their names, but n_chars, which is set to the new length of a changed text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import fresh

MIN_SCORE = 0.5
CONTEXT_CHARS, CONTEXT_BOOST = 40, 0.3
#: Running sums go by blocks of so many matches.
BLOCK = 256


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is divisible by ten."""

    def weighed(i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        double = 2 * d
        return F.when(i % 2 == 1, d).otherwise(double - F.when(double > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN (no spaces) has remainder 1 by 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97)

    return F.aggregate(F.split(turned, "(?<=.)(?=.)", -1), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A pattern with what confirms its matches and how sure they are."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    #: Every match has this string; texts without it aren't scanned.
    sure: str | None = None
    #: No match of the pattern is shorter.
    shortest: int = 2


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


#: Characters of an IBAN by country: the registry's, and those in use without being registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A known country's IBAN ends at its length, whatever follows; others go on as far as they can, but not into a known one."""
    known = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
    known = f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{known})(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{known}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"


def _parts_fit(m: Column) -> Column:
    """No number of a dotted one is over 255, leading zeros aside."""
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, r"(?i)\b(?:e-?mail|contact|write|mailto)\b", sure="@", shortest=5),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _parts_fit, 0.6, r"(?i)\b(?:ip|host|server|address|login)\b", sure=".", shortest=7),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", lambda m: _between(F.length(digits_of(m)), 16, 19) & F.coalesce(F.when(_between(F.length(digits_of(m)), 16, 19), luhn(digits_of(m))), F.lit(False)), 0.8, r"(?i)\b(?:card|visa|credit|debit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _between(F.length(digits_of(m)), 8, 15), 0.6, r"(?i)\b(?:phone|tel|call|mobile|fax)\b", sure="+", shortest=4),
    Kind("iban", _iban_pattern(), lambda m: _between(F.length(F.replace(m, F.lit(" "))), 15, 34) & mod97(F.replace(m, F.lit(" "))), 0.9, r"(?i)\b(?:iban|account|bank)\b", base=False, shortest=15),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"(?i)\b(?:ssn|social\x20security)\b", base=False, shortest=11),
)
BASE = tuple(k.name for k in KINDS if k.base)
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _sums(values: Column, start: Column) -> Column:
    """Exclusive running sums of an array, one after another."""
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def running(values: Column) -> Column:
    """Exclusive running sums by blocks, so that the cost is near linear in the number of matches."""
    n_blocks = F.greatest(F.lit(1), F.ceil(F.size(values) / BLOCK).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    bases = _sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)), F.lit(0))
    return F.flatten(F.zip_with(blocks, bases, _sums))


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(kind.sure)), found) if kind.sure else found


def _near(k: Kind, between: Column, matches: Column, i: Column) -> Column:
    """Whether a context word stands in the ``CONTEXT_CHARS`` code points before or after match ``i`` (0-based).

    The text around comes from the pieces next to the match: so many that they hold that
    much text in any case, and of each piece between matches its two ends alone.
    """
    reach = -(-CONTEXT_CHARS // k.shortest)
    ends = lambda p: F.when(F.length(p) <= 2 * CONTEXT_CHARS, p).otherwise(F.concat(F.left(p, F.lit(CONTEXT_CHARS)), F.right(p, F.lit(CONTEXT_CHARS))))
    first = F.greatest(F.lit(0), i - reach)
    before = F.concat(F.array_join(F.zip_with(F.slice(between, first + 1, i - first), F.slice(matches, first + 1, i - first), lambda p, m: F.concat(ends(p), m)), ""), ends(F.get(between, i)))
    after = F.concat(ends(F.get(between, i + 1)), F.array_join(F.zip_with(F.slice(matches, i + 2, F.lit(reach)), F.slice(between, i + 3, F.lit(reach)), lambda m, p: F.concat(F.coalesce(m, F.lit("")), ends(F.coalesce(p, F.lit(""))))), ""))
    return F.right(before, F.lit(CONTEXT_CHARS)).rlike(k.context) | F.left(after, F.lit(CONTEXT_CHARS)).rlike(k.context)


def _score(k: Kind, between: Column, matches: Column, i: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(k.score) + F.when(_near(k, between, matches, i), CONTEXT_BOOST).otherwise(0.0))


def _indices(matches: Column) -> Column:
    """0 to the number of matches less one."""
    return F.sequence(F.lit(0), F.size(matches) - 1)


def find_pii(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, spans (kind, start, end, value, score by kind, then start) and n_<kind> for each row."""
    (text,) = fresh(docs, "_text")
    match, piece, start, span = ({k.name: n for k, n in zip(KINDS, fresh(docs, *(f"_{c}_{k.name}" for k in KINDS)), strict=True)} for c in ("match", "piece", "start", "span"))
    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias(text))
    rows = rows.select("*", *[_matches(F.col(text), k).alias(match[k.name]) for k in KINDS])
    some = {k.name: F.coalesce(F.size(match[k.name]), F.lit(0)) > 0 for k in KINDS}
    # what stands before each match, then the match: the sums at odd places are the starts
    rows = rows.select("*", *[F.when(some[k.name], F.split(text, k.pattern, -1)).alias(piece[k.name]) for k in KINDS])
    steps = {k.name: F.zip_with(F.slice(piece[k.name], F.lit(1), F.size(match[k.name])), match[k.name], lambda p, m: F.length(p) + F.length(m)) for k in KINDS}
    rows = rows.select("*", *[F.when(some[k.name], running(steps[k.name])).alias(start[k.name]) for k in KINDS])

    def spans(k: Kind) -> Column:
        between, matches, starts = (F.col(c[k.name]) for c in (piece, match, start))

        def one(i: Column) -> Column:
            m = F.get(matches, i)
            at = F.get(starts, i) + F.length(F.get(between, i))
            return F.struct(F.lit(k.name).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value"), _score(k, between, matches, i).alias("score"))

        found = F.transform(F.filter(_indices(matches), lambda i: k.valid(F.get(matches, i))), one)
        found = found if k.base else F.filter(found, lambda s: s["score"] >= MIN_SCORE)
        return F.when(some[k.name], found.cast(SPAN)).otherwise(F.array().cast(SPAN)).alias(span[k.name])

    rows = rows.select(*carry, *[spans(k) for k in KINDS])
    return rows.select(*carry, F.concat(*[span[k.name] for k in KINDS]).alias("spans"), *[F.size(span[k.name]).cast("long").alias(f"n_{k.name}") for k in KINDS])


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted(k: Kind, between: Column, matches: Column, mark: str) -> Column:
    """The text of ``between`` and ``matches`` with the confirmed matches of ``k`` replaced."""

    def piece(i: Column) -> Column:
        m = F.get(matches, i)
        sure = k.valid(m)
        if not k.base:
            sure = sure & (_score(k, between, matches, i) >= MIN_SCORE)
        return F.concat(F.get(between, i), F.when(sure, mark.format(k.name.upper())).otherwise(m))

    return F.concat(F.array_join(F.transform(_indices(matches), piece), ""), F.element_at(between, -1))


def redact_pii(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """The documents with all spans replaced by a mark of their kind, kind after kind in linear time."""
    columns = docs.columns
    text, match, piece = fresh(docs, "_text", "_match", "_piece")
    out = docs.withColumn(text, F.col("text"))
    for k in KINDS:
        out = out.withColumn(match, _matches(F.col(text), k))
        some = F.coalesce(F.size(match), F.lit(0)) > 0
        out = out.withColumn(piece, F.when(some, F.split(text, k.pattern, -1)))
        out = out.withColumn(text, F.when(some, _redacted(k, F.col(piece), F.col(match), mark)).otherwise(F.col(text)))
    changed = {"text": F.col(text)}
    if "n_chars" in columns:
        same = F.col(text).eqNullSafe(F.col("text"))
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])
