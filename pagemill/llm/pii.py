"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Patterns name candidate spans. For each candidate six labelers vote: the strict
format (checksums among them), a gazetteer (given names, issuers' prefixes,
country codes and such), cue words before it, its setting (a label's colon, an
assignment, quotation marks), its shape, and the absence of words that say it
is something harmless. They disagree, and none is right for each kind. Votes
are counted by pattern of votes (some hundreds of rows, whatever the corpus),
and expectation-maximisation on these counts estimates each labeler's
reliability for each kind and every pattern's probability. These are the soft
labels of a logistic span classifier over votes and binned features, again
trained on counts alone, and its table of scores, as small, decides on the
spans that the patterns don't settle: all but those of the four base kinds.

DataFrame functions only: matches and the gaps between them are taken by
regular expressions, and places follow from running sums of their lengths.
Texts aren't shuffled. Expressions have possessive quantifiers, so that
very long texts need neither deep recursion nor quadratic time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import cut

#: In the order in which spans that start together are listed; the first four are settled by their pattern.
KINDS = ("email", "ip", "card", "phone", "secret", "name", "iban", "ssn", "birth")
BASE = KINDS[:4]
_LOCAL, _TOKEN = r"A-Za-z0-9._%+\-", r"A-Za-z0-9_/+\-"
GIVEN_NAMES = (
    "Aaron Adam Alan Albert Alejandro Alexander Alice Amanda Amelia Andrea Andreas Andrew Angela Anita Anna Anthony Antonio Barbara Beatrice "
    "Benjamin Bernard Brian Camille Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine Christopher Claire Claudia Daniel "
    "David Deborah Diana Diego Dmitri Dorothy Edward Elena Elizabeth Emily Emma Eric Esther Eva Fatima Felix Fernando Francesca Francois Frank "
    "Gabriel George Gerhard Giovanni Grace Hannah Harold Heinrich Helen Henry Hiroshi Ibrahim Ingrid Isabel Ivan Jacob James Janet Javier "
    "Jennifer Jessica Joan Johannes John Jonathan Jorge Joseph Juan Judith Julia Julien Karen Karl Katarina Kenneth Kevin Laura Lauren Leonardo "
    "Linda Lisa Louis Lucia Lukas Manuel Margaret Maria Marie Mario Mark Martha Martin Mary Matthew Maximilian Melissa Michael Michelle Miguel "
    "Mohammed Monika Nancy Natalia Nicholas Nicole Nora Olga Oliver Olivia Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Rebecca "
    "Richard Robert Roberto Rosa Ruth Samuel Sandra Sarah Sebastian Simon Sofia Sophie Stefan Stephen Susan Thomas Timothy Ursula Valentina "
    "Victor Victoria Vincent Walter William Wolfgang Yusuf"
).split()
_WORD = r"\p{Lu}\p{Ll}++"
_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.? "
#: Leftmost matches that don't overlap, as the plain patterns give them: a run's first character
#: starts a match, or what follows the last match. Runs of digits that can't be cards are passed over.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # of any length, of one part or of several joined by dots, with a digit and a letter in its first
    "secret": rf"(?<![{_TOKEN}@])(?<![{_TOKEN}]\.)(?=[A-Za-z_/+\-]*+[0-9])(?=[0-9_/+\-]*+[A-Za-z])"
    rf"(?:[{_TOKEN}]{{20,}}+(?:\.[{_TOKEN}]{{10,}}+)*+|[{_TOKEN}]{{10,19}}+(?:\.[{_TOKEN}]{{10,}}+)++)={{0,2}}+(?![{_TOKEN}@])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLES}{_WORD}|(?:{'|'.join(GIVEN_NAMES)}) {_WORD})(?:[ -]{_WORD}){{0,2}}+(?!\p{{L}})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "birth": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])",
}
GUARDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": "", "name": " ", "iban": "", "ssn": "-", "birth": ""}
#: Cue words before a span, by kind.
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|to|from|reply)\b",
    "ip": r"(?i)\b(ip|host|server|addr(ess)?|client|node)\b",
    "card": r"(?i)\b(card|visa|master(card)?|amex|credit|debit|payment|account|number)\b",
    "phone": r"(?i)\b(tel|phone|telephone|call|fax|mobile|cell|whatsapp|dial)\b",
    "secret": r"(?i)(\b|_)(token|secret|passw(or)?d|pwd|api[ _-]?key|key|auth|bearer|credentials?)(\b|_)",
    "name": r"(?i)\b(name|named|dear|signed|regards|sincerely|by|author|contact|patient|customer|employee|attn)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(ssn|social security|tax(payer)? id|national id|insurance n(o|umber))\b",
    "birth": r"(?i)\b(born|birth(day|date)?|dob|geboren|né(e)?|nacid[oa]|geburtsdatum)\b",
}
#: What says, before a span, that it is no personal data or secret.
HARMLESS = {
    "email": r"(?i)\b(example|sample|placeholder|noreply)\b",
    "ip": r"(?i)(\bv|version|release|section|chapter|[0-9]\.)\s*$",
    "card": r"(?i)\b(isbn|order|sku|invoice|tracking|serial|id)\b",
    "phone": r"(?i)\b(fax line|example|sample)\b",
    "secret": r"(?i)(\b|_)(commit|sha-?(1|256|512)?|md5|checksum|hash|digest|uuid|guid|etag|rev(ision)?|build|file|path|url|href|src|model|serial)(\b|_)",
    "name": r"(?i)\b(saint|st|street|avenue|university|hospital|airport|award|prize|the)\W*$",
    "iban": r"(?i)\b(part|model|serial|order|sku)\b",
    "ssn": r"(?i)\b(part|model|serial|order|sku|isbn|fax|phone)\b",
    "birth": r"(?i)\b(published|posted|updated|created|released|modified|copyright|version|due|until|since|from|on|date)\b",
}
#: Issuers' prefixes of keys and tokens.
_PREFIXES = r"^(gh[opsur]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|pk_live_|AKIA|ASIA|AIza|ya29|xox[abpsr]-|eyJ|npm_|pypi-|hf_|shpat_|dop_v1_|SG\.)"
_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK "
    "MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK"
).replace(" ", "|")
GAZETTEERS = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|co|info|biz|eu|us|uk|de|fr|es|it|nl|ch|at|be|se|no|dk|pl|ru|jp|cn|in|br|ca|au)$",
    "ip": r"^(10|127|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": _PREFIXES,
    "name": rf"(?:^|\s)(?:{'|'.join(GIVEN_NAMES)})\s",
    "iban": rf"^({_COUNTRIES})",
    "ssn": r"^(?!000|666|9)",
    "birth": r"(19[0-9]{2}|200[0-9])",
}
LABELERS, CONTEXT, ROUNDS = 6, 24, 80
#: Prior beliefs: how often each labeler votes for a true, and for a false candidate; and the share of true ones.
PRIOR_HITS = (0.9, 0.5, 0.4, 0.4, 0.85, 0.97)
PRIOR_ALARMS = (0.3, 0.15, 0.05, 0.15, 0.4, 0.7)
PRIOR_TRUE, STRENGTH = {"birth": 0.2}, 20


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits of a match of at most 19 digits pass the Luhn check."""
    digits = F.reverse(_digits(match))
    total = F.lit(0)
    for i in range(19):
        d = F.coalesce(F.try_to_number(F.substring(digits, i + 1, 1), F.lit("9")).cast("int"), F.lit(0))
        total = total + (d if i % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Whether a base match stands; other kinds are left to the classifier."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.char_length(_digits(match))
    return (
        F.when(kind == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", _luhn(match))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .otherwise(True)
    )


def _matches(kind: str) -> Column:
    """(kind, i, gap, match, before, after) of each match, in order; gap: the characters since the last.

    From the columns that ``_parts`` makes: gaps are looked up, not split anew for each match.
    """
    gaps = F.col(f"gaps_{kind}")
    return F.transform(
        f"found_{kind}",
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.char_length(F.get(gaps, i)).alias("gap"),
            m.alias("match"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"),
        ),
    )


def _parts(kind: str) -> dict[str, Column]:
    """The matches of a kind in the column t, and what is between them; null without matches."""
    t, pattern = F.col("t"), PATTERNS[kind]
    guard = F.contains(t, F.lit(GUARDS[kind])) if GUARDS[kind] else F.lit(True)
    if kind not in ("email", "name"):
        guard = guard & t.rlike("[0-9]")
    guard = guard & t.rlike(pattern)
    return {
        f"found_{kind}": F.when(guard, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))),
        f"gaps_{kind}": F.when(guard, F.split(t, pattern, -1)),
    }


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each match of each kind, and one with a null kind for a text without any:
    row, doc_id, kind, start, end, match, before, after. Written out once."""
    placed = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,before:string,after:string>>")
    parts = placed.withColumns({c: e for k in KINDS for c, e in _parts(k).items()})
    found = F.concat(*[F.coalesce(_matches(k), none) for k in KINDS])
    rows = parts.select("row", "doc_id", F.explode_outer(found).alias("m")).select("row", "doc_id", "m.*")
    rows = cut(rows)
    upto = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.char_length("match")).over(upto)
    named = rows.where("kind is not null").withColumn("end", end)
    named = named.withColumn("start", F.col("end") - F.char_length("match"))
    columns = ("row", "doc_id", "kind", "start", "end", "match", "before", "after")
    empty = rows.where("kind is null").selectExpr("row", "doc_id", "kind", "null start", "null end", "match", "before", "after")
    return named.select(*columns).unionByName(empty)


def _iban_checked(match: Column) -> Column:
    """Whether an IBAN's letters and digits leave a remainder of 1 by 97."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def with_votes(spans: DataFrame) -> DataFrame:
    """``spans`` with ``valid``, the labelers' votes v0 to v5 and the binned features f0 and f1."""
    kind, m, before = F.col("kind"), F.col("match"), F.col("before")
    n, digits = F.char_length(m), F.char_length(_digits(m))
    mixed = m.rlike("[a-z]") & m.rlike("[A-Z]")
    year = F.regexp_extract(m, "([0-9]{4})", 1).try_cast("int")
    strict = (
        F.when(kind == "email", m.rlike(r"\.[A-Za-z]{2,}$"))
        .when(kind == "secret", m.rlike(_PREFIXES) | (mixed & (digits >= 3)))
        .when(kind == "name", m.rlike(rf"^(?:{_TITLES})?{_WORD} {_WORD}"))
        .when(kind == "iban", _iban_checked(m))
        .when(kind == "ssn", ~m.rlike("^(000|666|9)|-00-|-0000$"))
        .when(kind == "birth", m.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$|^(0?[1-9]|[12][0-9]|3[01])[./](0?[1-9]|[12][0-9]|3[01])[./]"))
        .otherwise(F.col("valid"))
    )
    by_kind = lambda patterns, of: F.coalesce(*[F.when(kind == k, of.rlike(p)) for k, p in patterns.items()])
    setting = before.rlike(r"[=:\"'`(<\[]\s*$") | F.col("after").rlike(r"^[\"'`>)\]]")
    shape = (
        F.when(kind == "email", ~m.rlike(r"^[._%+-]|\.\."))
        .when(kind == "ip", ~m.rlike(r"^0"))
        .when(kind == "card", ~m.rlike(r"^([0-9])\1*$"))
        .when(kind == "phone", m.rlike(r"[\x20().-]"))
        .when(kind == "name", ~before.rlike(r"(^|[.!?:\n])\s*$"))
        .when(kind == "iban", (n >= 15) & (digits >= 10))
        .when(kind == "ssn", ~m.rlike(r"^([0-9])\1\1-"))
        .when(kind == "birth", (year >= 1900) & (year <= 2020))
        .otherwise((digits >= F.when(mixed, 0.08).otherwise(0.15) * n) & (digits <= 0.85 * n) & ~m.rlike(r"[/_+-].*[/_+-].*[/_+-]"))
    )
    votes = [strict, by_kind(GAZETTEERS, m), by_kind(CUES, before), setting, shape, ~by_kind(HARMLESS, before)]
    spans = spans.withColumns({f"v{j}": F.coalesce(v, F.lit(False)).cast("int") for j, v in enumerate(votes)})
    size = F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).when(n < 36, 3).when(n < 48, 4).otherwise(5)
    return spans.withColumns({"f0": size, "f1": F.floor(4 * digits / n).cast("int")})


@dataclass
class Reliability:
    """What EM found for one kind: the share of true candidates, and each labeler's rates of votes."""

    prior: float
    hits: list[float]
    alarms: list[float]

    def posterior(self, votes: tuple[int, ...]) -> float:
        yes, no = math.log(self.prior), math.log(1 - self.prior)
        for v, a, b in zip(votes, self.hits, self.alarms):
            yes += math.log(a if v else 1 - a)
            no += math.log(b if v else 1 - b)
        return 1 / (1 + math.exp(min(500.0, no - yes)))


def reliabilities(counts: dict[tuple[int, ...], int], true: float = 0.5, rounds: int = ROUNDS) -> Reliability:
    """EM over the counts of vote patterns of one kind.

    Beta priors, worth STRENGTH candidates, hold what is known of labelers
    before any vote: that a cue rarely stands before a false candidate, but
    is often lacking before a true one, and so on. They also keep the two
    classes from changing places.
    """
    found = Reliability(true, list(PRIOR_HITS), list(PRIOR_ALARMS))
    for _ in range(rounds):
        p = {v: found.posterior(v) for v in counts}
        yes = sum(p[v] * n for v, n in counts.items())
        no = sum((1 - p[v]) * n for v, n in counts.items())
        found = Reliability(
            (yes + STRENGTH * true) / (yes + no + STRENGTH),
            [(sum(p[v] * n for v, n in counts.items() if v[j]) + STRENGTH * PRIOR_HITS[j]) / (yes + STRENGTH) for j in range(LABELERS)],
            [(sum((1 - p[v]) * n for v, n in counts.items() if v[j]) + STRENGTH * PRIOR_ALARMS[j]) / (no + STRENGTH) for j in range(LABELERS)],
        )
    return found


def _features(kind: str, votes: tuple[int, ...], f0: int, f1: int) -> tuple[str, ...]:
    return ("1", f"k{kind}", f"{kind}l{f0}", f"{kind}d{f1}", *(f"{kind}v{j}" for j, v in enumerate(votes) if v))


def train(cells: list[tuple[str, tuple[int, ...], int, int, int]], steps: int = 300) -> dict[tuple, float]:
    """Scores of each cell (kind, votes, f0, f1, count) by a logistic classifier with EM's soft labels."""
    by_kind: dict[str, dict[tuple[int, ...], int]] = {}
    for kind, votes, _, _, n in cells:
        of = by_kind.setdefault(kind, {})
        of[votes] = of.get(votes, 0) + n
    known = {kind: reliabilities(counts, PRIOR_TRUE.get(kind, 0.5)) for kind, counts in by_kind.items()}
    total = max(1, sum(c[4] for c in cells))
    rows = [(_features(*c[:4]), known[c[0]].posterior(c[1]), c[4] / total) for c in cells]
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(steps):
        slope: dict[str, float] = {}
        for names, y, share in rows:
            z = sum(weights.get(x, 0.0) for x in names)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * share
            for x in names:
                slope[x] = slope.get(x, 0.0) + error
        for x, g in slope.items():
            g += 1e-4 * weights.get(x, 0.0)
            squares[x] = squares.get(x, 1e-12) + g * g
            weights[x] = weights.get(x, 0.0) - 0.5 * g / math.sqrt(squares[x])
    return {
        c[:4]: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in names)))))
        for c, (names, _, _) in zip(cells, rows)
    }


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, kind, start, end, score) of each span found, and a row without a kind for each
    text without candidates.

    Spans of the base kinds stand if their match is valid. Other candidates
    stand if the classifier gives them a half or more.
    """
    voted = cut(with_votes(candidates(docs, text, doc_id).withColumn("valid", _valid(F.col("kind"), F.col("match")))))
    votes = [f"v{j}" for j in range(LABELERS)]
    cell = ["kind", *votes, "f0", "f1"]
    # 9 kinds x 64 votes x 6 x 5 bins at most
    counted = voted.where("kind is not null").groupBy(*cell).count().collect()
    cells = [(r["kind"], tuple(r[v] for v in votes), r["f0"], r["f1"], r["count"]) for r in counted]
    table = [(k, *v, f0, f1, p) for (k, v, f0, f1), p in train(cells).items()]
    schema = f"kind string, {', '.join(f'{v} int' for v in votes)}, f0 int, f1 int, score double"
    scores = docs.sparkSession.createDataFrame(table, schema)
    scored = voted.join(F.broadcast(scores), cell, "left")
    base = F.col("kind").isin(*BASE)
    stands = (base & F.col("valid")) | (~base & (F.col("score") >= 0.5))
    named = F.when(stands, F.col("kind"))
    return scored.select("row", "doc_id", named.alias("kind"), "start", "end", "score")


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_name, n_iban, n_ssn,
    n_birth, n_spans) of each row; n_spans counts all.

    Null and empty texts have no spans: counts of 0, the hash of an empty
    string and an empty string. Texts of any length are searched whole. A null
    doc_id stays null; repeated rows are each returned; no rows give none.
    Other columns are ignored, whatever their names.
    """
    found = spans(docs, text, doc_id)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    base = F.col("kind").isin(*BASE)
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["said"]), ",")
    by_row = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(count(k) for k in KINDS),
        F.count("kind").alias("n_spans"),
        said(F.collect_list(F.when(base, entry))).alias("base"),
        said(F.collect_list(F.when(F.col("kind").isNotNull(), entry))).alias("spans"),
    )
    counts = [f"n_{k}" for k in KINDS]
    return by_row.select("doc_id", *counts[:4], F.sha2("base", 256).alias("base_sha256"), "spans", *counts[4:], "n_spans")
