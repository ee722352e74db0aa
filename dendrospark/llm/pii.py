"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Four labelers then vote on each (yes, no or abstain):
``form`` (the kind's own check: Luhn, digit counts, the check digits' place),
``gazetteer`` (known endings of domains, country codes, reserved address blocks),
``context`` (cue words shortly before the span, of either sign) and ``edge`` (the
span is not part of a longer token). Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability and a prior per kind; its
posteriors are the soft labels on which the final classifier, a naive Bayes over
kind, votes, length and share of digits, is trained. Both see only counts: at
most kinds x 3^4 x 9 rows reach the driver, whatever the input.

Spans of the base kinds (email, ip, card, phone) follow fixed rules and are always
reported. The classifier decides on all other proposals: what fails a base rule's
check but may be a mistyped one (``card_like``, ``ip_like``, ``phone_like``), addresses
without a domain's ending, masked addresses, national ids, IBANs, phone numbers
without a country code, and account numbers. Those it accepts are added where no
base span lies. Texts are scanned once; the spans, a small table,
are written to the shared folder between counting and deciding.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BASE = ("email", "ip", "card", "phone")
LIKE = {"card": "card_like", "ip": "ip_like", "phone": "phone_like"}
KINDS = (*BASE, "masked_email", "national_id", "iban", "local_phone", *LIKE.values(), "bare_email", "account")
LABELERS = ("form", "gazetteer", "context", "edge")

# The base rules, written so that a search is linear: runs are taken whole
# (possessive), and start only where no run is cut, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MORE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)++"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    r"|(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![.A-Za-z0-9-])"
    r"|(?<![A-Za-z0-9.+-])(?<![0-9]\x20)[0-9]{8,11}+(?![A-Za-z0-9])(?![\x20.-][0-9])"
)
# Gazetteers and cue words.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|be|us|ca|mx|ar|co"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|351|352|353|358|420|421"
IBAN_LANDS = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"
CUES = r"(?i)\b(?:e-?mail|mail|contact|kontakt|contacto|phone|tel|call|fax|mobile|handy|ssn|social|iban|konto|account|compte|cuenta|card|karte|carte|tarjeta|ip|address|adresse|host|server)\b"
ANTI = r"(?i)\b(?:version|release|isbn|issn|order|invoice|article|page|section|figure|part no|serial)\b"


def found(text: Column, pattern: str) -> Column:
    """Spans {start, end, s} of a pattern, in code points: what lies between the matches gives their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("p"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s")))).alias("out")))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    d = F.reverse(digits(s))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def ip_ok(s: Column) -> Column:
    part = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def phone_ok(s: Column) -> Column:
    return F.length(digits(s)).between(9, 15)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labelled(text: Column, spans: Column, name: str | None, kind: str | None = None) -> Column:
    """Spans with their kind and votes; ``kind`` names them otherwise than the base kind whose labelers vote."""

    def one(x: Column) -> Column:
        s = x["s"]
        k = F.lit(kind or name) if name else F.when(s.rlike(r"[\[(](?:at|AT)[\])]"), "masked_email").when(s.contains("@"), "bare_email").when(s.rlike("^[0-9]{8,11}$"), "account").when(s.rlike(r"^[0-9]{3}-[0-9]{2}-"), "national_id").when(s.rlike("^[A-Z]"), "iban").otherwise("local_phone")
        before = F.substring(text, F.greatest(F.lit(1), x["start"] - 31), F.least(F.lit(32), x["start"]))
        near = F.substring(text, F.greatest(F.lit(1), x["start"]), F.when(x["start"] > 0, 1).otherwise(0))
        after = F.substring(text, x["end"] + 1, F.lit(1))
        n = F.length(digits(s))
        form = (
            vote(luhn(s), ~luhn(s)) if name == "card" else vote(ip_ok(s), ~ip_ok(s)) if name == "ip" else vote(phone_ok(s), ~phone_ok(s)) if name == "phone"
            else F.lit(1) if name == "email"
            else F.when(k == "national_id", vote(~s.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit(True))).when(k == "iban", vote(F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34), F.lit(True))).when(k == "masked_email", F.lit(1)).when(k.isin("bare_email", "account"), F.lit(0)).otherwise(vote(s.rlike(r"^\(?[2-9]"), F.lit(True)))
        )
        gazetteer = (
            vote(s.rlike(rf"(?i)\.(?:{ENDINGS})$"), s.rlike(r"\.[0-9]+$")) if name == "email" else vote(~s.rlike(r"^0*(?:0|127|255)\."), F.lit(True)) if name == "ip" else vote(s.rlike(r"^[3-6]"), s.rlike("^0")) if name == "card"
            else vote(s.rlike(rf"^\+(?:{CALLING})(?:[^0-9]|$)|^\+[0-9]{{9,}}"), F.lit(False)) if name == "phone"
            else F.when(k == "iban", vote(s.rlike(rf"^(?:{IBAN_LANDS})"), F.lit(True))).when(k == "masked_email", vote(s.rlike(rf"(?i)(?:\.|[\])]\x20?)(?:{ENDINGS})$"), F.lit(True))).otherwise(F.lit(0))
        )
        word = r"[\p{L}\p{N}_]"
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), k.alias("kind"),
            form.cast("int").alias("form"), gazetteer.cast("int").alias("gazetteer"), vote(before.rlike(CUES), before.rlike(ANTI)).alias("context"),
            vote(~near.rlike(word) & ~after.rlike(word), near.rlike(word) & after.rlike(word)).alias("edge"),
            F.least(F.lit(2), F.floor(F.length(s) / 12)).cast("int").alias("size"), F.least(F.lit(2), F.floor(3 * n / F.length(s))).cast("int").alias("share"),
        )

    return F.transform(spans, one)


def proposed(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra): labelled spans of each row, base ones filtered by their rules."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text")
    # A character that every match needs is looked for first.
    has = {"email": F.col("text").contains("@"), "ip": F.col("text").contains("."), "phone": F.col("text").contains("+")}
    none = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")
    raw = docs
    for name, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("more", MORE)):
        raw = raw.withColumn(name, F.when(has[name], found(F.col("text"), pattern)).otherwise(none) if name in has else found(F.col("text"), pattern))
    for name, ok in (("ip", ip_ok), ("card", luhn), ("phone", phone_ok)):
        raw = raw.withColumn(LIKE[name], F.filter(name, lambda x: ~ok(x["s"]))).withColumn(name, F.filter(name, lambda x: ok(x["s"])))  # noqa: B023 (used at once)
    text = F.col("text")
    base = F.concat(*[labelled(text, F.col(k), k) for k in BASE])
    more = F.concat(labelled(text, F.col("more"), None), *[labelled(text, F.col(kind), name, kind) for name, kind in LIKE.items()])
    raw = raw.select("doc_id", base.alias("base"), more.alias("extra"))
    free = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return raw.select("doc_id", "base", free.alias("extra"))


def vote_counts(spans: DataFrame) -> list[dict]:
    """Counts of kind, votes and features; bounded by their combinations."""
    each = spans.select(F.explode(F.concat("base", "extra")).alias("x")).select("x.*")
    return [r.asDict() for r in each.groupBy("kind", *LABELERS, "size", "share").count().collect()]


class Model:
    """Labelers' reliabilities and the naive Bayes classifier, from counts."""

    def __init__(self, counts: list[dict], rounds: int = 40):
        self.counts = sorted(counts, key=lambda r: tuple(map(str, r.values())))
        # Start from the majority vote, then alternate.
        post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(r[lab] for lab in LABELERS))) for r in self.counts]
        for _ in range(rounds):
            self.prior = self._shares("kind", post)
            self.reliability = {lab: self._table(lab, post) for lab in LABELERS}
            post = [self._posterior(r, self.reliability, LABELERS) for r in self.counts]
        self.features = {f: self._table(f, post) for f in (*LABELERS, "size", "share")}

    def _shares(self, field: str, post: list[float]) -> dict[str, float]:
        """Prior of each kind; kinds that were never seen start even."""
        yes, all_ = defaultdict(float), defaultdict(float)
        for r, p in zip(self.counts, post, strict=True):
            yes[r[field]] += p * r["count"]
            all_[r[field]] += r["count"]
        return {k: (yes[k] + 1) / (all_[k] + 2) for k in KINDS}

    def _table(self, field: str, post: list[float]) -> dict[int, tuple[float, float]]:
        """P(value | real), P(value | not), smoothed towards a labeler that is right two times in three."""
        values = (-1, 0, 1) if field in LABELERS else (0, 1, 2)
        start = {1: (4.0, 2.0), 0: (3.0, 3.0), -1: (2.0, 4.0)} if field in LABELERS else dict.fromkeys(values, (1.0, 1.0))
        sums = {v: list(start[v]) for v in values}
        for r, p in zip(self.counts, post, strict=True):
            sums[r[field]][0] += p * r["count"]
            sums[r[field]][1] += (1 - p) * r["count"]
        one, none = (sum(s[i] for s in sums.values()) for i in (0, 1))
        return {v: (s[0] / one, s[1] / none) for v, s in sums.items()}

    def _posterior(self, r: dict, tables: dict, fields) -> float:
        p = self.prior[r["kind"]]
        x = math.log(p) - math.log(1 - p) + sum(math.log(tables[f][r[f]][0]) - math.log(tables[f][r[f]][1]) for f in fields)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))

    def score(self, x: Column) -> Column:
        """The classifier's log-odds for a span struct."""
        kind = F.element_at(F.create_map(*[v for k in KINDS for v in (F.lit(k), F.lit(math.log(self.prior[k] / (1 - self.prior[k]))))]), x["kind"])
        for f, table in self.features.items():
            low = min(table)
            kind = kind + F.element_at(F.array(*[F.lit(math.log(table[v][0] / table[v][1])) for v in sorted(table)]), x[f] - low + 1)
        return kind


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = F.create_map(*[v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))])
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.element_at(place, x["kind"]).alias("place"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    No shuffle but that of the vote counts. Null text counts as empty; repeated
    rows and null ids give a row each; a table without rows gives none; further
    columns are not read; without any span the classifier falls back to its
    starting values.
    """
    spans = written(proposed(docs), "spans")
    model = Model(vote_counts(spans))
    edge = math.log(least / (1 - least))
    added = F.filter("extra", lambda x: model.score(x) >= edge)
    all_ = spans.withColumn("found", F.concat("base", added))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return all_.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
