"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) always stand.  Wider patterns propose more spans of the same kinds.  Every
candidate, base or not, is judged by labelers that vote yes, no or not at all: the strict pattern, the shape, a check
computation, a gazetteer, and the words around it.  The votes of the whole corpus are counted per vote pattern (at most
3^5 per kind, whatever the corpus size), expectation-maximisation estimates each labeler's reliability and each
pattern's probability from these counts, and a logistic regression trained on the patterns, weighted by count and
probability, is the final span classifier.  A proposed span is added when the classifier gives it at least one half and
it overlaps no base span of its kind.

Patterns are anchored so that every text is scanned in linear time, and whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.session import settle

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "shape", "check", "gazetteer", "context")

# fixed values: the base patterns of the data contract; possessive forms and anchors change the cost, not the matches
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# wider patterns
_SPOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({<]\s?at\s?[\])}>]\s?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\.)[A-Za-z0-9-]{1,63}){1,8}",
    re.I,
)
_SPOKEN_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]", re.I)
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")

# fixed values: names that often stand in or beside such data
DOMAINS = set("com org net edu gov mil int info biz io dev app co us uk de fr es it nl ch at be pt eu example test".split())
CARD_HEADS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "36")
PHONE_HEADS = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
NEAR = {
    "email": set("email mail e-mail mailto contact write correo courriel kontakt".split()),
    "ip": set("ip ipv4 ipv6 server host address addr adresse".split()),
    "card": set("card credit debit visa mastercard payment carte karte tarjeta".split()),
    "phone": set("phone tel telephone call mobile fax cell sms telefon teléfono téléphone whatsapp".split()),
}
AGAINST = set("version release isbn issn doi order invoice ticket sku serial build page pages vol ref".split())
REACH = 40  # characters around a span whose words count as its context

SPAN = "struct<kind: string, start: int, end: int>"
FOUND = f"struct<base: array<{SPAN}>, wide: array<struct<kind: string, start: int, end: int, votes: string>>, base_votes: array<struct<kind: string, votes: string>>, base_sha256: string>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards: all starts before one @ share its fate."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of one text, by kind as listed, then start."""
    spans = [("email", *s) for s in _emails(text)]
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


def _octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def wide_spans(text: str, base: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap no base span of any kind."""
    spans = []
    if _SPOKEN_AT.search(text):
        spans += [("email", *m.span()) for m in _SPOKEN.finditer(text)]
    if text.count(":") >= 7:
        spans += [("ip", *m.span()) for m in _IP6.finditer(text)]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
    spans += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    free, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2], x[0])):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at == len(taken) or taken[at][0] >= e:
            free.append((kind, s, e))
    return free


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """One character per labeler: + yes, - no, 0 not at all."""
    span = text[start:end]
    digits = _digits(span)
    near = set(re.findall(r"[\w-]+", text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()))
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    shape, check, known = "0", "0", "0"
    if kind == "email":
        shape = "+" if edge and len(span) <= 254 else "-"
        known = "+" if re.split(r"[^A-Za-z0-9-]+", span.strip("])}> ").lower())[-1] in DOMAINS else "-"
    elif kind == "ip":
        shape = "+" if edge else "-"
        known = "+" if span.startswith(("10.", "192.168.", "172.16.", "127.")) else "0"
    elif kind == "card":
        shape = "+" if edge and (span == digits or re.fullmatch(r"\d{4}(?:([ -])\d{4})(?:\1\d{4}){2}\d{0,3}|\d{4}([ -])\d{6}\2\d{5}", span)) else "-"
        check = "+" if luhn(digits) else "-"
        known = "+" if digits.startswith(CARD_HEADS) else "-"
    else:
        shape = "+" if edge and 9 <= len(digits) <= 13 else "-"
        known = "+" if span[0] == "+" and digits.startswith(PHONE_HEADS) else "0"
    context = "+" if near & NEAR[kind] else "-" if near & AGAINST else "0"
    return f"{'+' if strict else '0'}{shape}{check}{known}{context}"


def _scan(text: str) -> tuple[list, list, list, str]:
    base = base_spans(text)
    wide = [(k, s, e, votes(text, k, s, e, False)) for k, s, e in wide_spans(text, base)]
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    return base, wide, [(k, votes(text, k, s, e, True)) for k, s, e in base], digest


def scan(text: Column) -> Column:
    """Base spans, wide candidates with votes, votes of the base spans, and the digest of the base spans."""

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        wide = pa.struct([*span, pa.field("votes", pa.string())])
        vote = pa.struct([("kind", pa.string()), ("votes", pa.string())])
        types = (pa.list_(span), pa.list_(wide), pa.list_(vote), pa.string())
        names = ("base", "wide", "base_votes", "base_sha256")
        for texts in batches:
            rows = [_scan(t.as_py() or "") for t in texts]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            arrays = []
            for values, kind in zip(columns, types, strict=True):
                if pa.types.is_list(kind):
                    keys = [f.name for f in kind.value_type]
                    values = [[dict(zip(keys, v, strict=True)) for v in row] for row in values]
                arrays.append(pa.array(values, kind))
            yield pa.StructArray.from_arrays(arrays, names)

    return run.asNondeterministic()(text)


def reliabilities(counts: dict[str, float], rounds: int = 50) -> tuple[dict[str, float], float, np.ndarray]:
    """EM over vote patterns of one kind: probability per pattern, the prior of wide candidates, and per labeler
    P(vote | class).

    Votes are taken as independent given the class.  Candidates of the strict pattern and wide ones have priors of their
    own, so that many plain finds do not vouch for doubtful ones; the strict vote itself is then no further evidence.
    Pseudo-counts state that labelers are more often right than wrong, which settles which class is which and holds small
    corpora.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    code = np.array([["+0-".index(c) for c in p] for p in patterns])
    prior_counts = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]]) * 2  # class yes, no; votes +, 0, -
    q = 1 / (1 + np.exp(-((code == 0).sum(1) - (code == 2).sum(1) - 0.5)))
    table = np.zeros((len(LABELERS), 2, 3))
    strict = code[:, 0] == 0
    prior = np.array([0.5, 0.5])  # wide, strict
    for _ in range(rounds):
        weights = np.stack([n * q, n * (1 - q)])
        prior = np.array([(weights[0][part].sum() + 1) / (n[part].sum() + 2) for part in (~strict, strict)])
        for j in range(len(LABELERS)):
            for c in range(2):
                seen = np.bincount(code[:, j], weights[c], 3) + prior_counts[c]
                table[j, c] = seen / seen.sum()
        own = prior[strict.astype(int)]
        log = np.log([own, 1 - own]) + sum(np.log(table[j][:, code[:, j]]) for j in range(1, len(LABELERS)))
        q = 1 / (1 + np.exp(np.clip(log[1] - log[0], -60, 60)))
    return dict(zip(patterns, q.tolist(), strict=True)), float(prior[0]), table


def fit(found: DataFrame) -> DataFrame:
    """(kind, votes, n, em, p): every vote pattern with its EM and its classifier probability.

    `found` has the column `f` of `scan`, already written.  The result is bounded by the number of patterns.
    """
    spark = found.sparkSession
    cast = F.flatten(F.array(
        F.transform("f.wide", lambda w: F.struct(w["kind"].alias("kind"), w["votes"].alias("votes"))), F.col("f.base_votes")
    ))
    counted = found.select(F.explode(cast).alias("v")).groupBy("v.kind", "v.votes").agg(F.count(F.lit(1)).alias("n"))
    rows = [(r["kind"], r["votes"], r["n"]) for r in counted.collect()]  # at most 3^5 patterns per kind
    schema = "kind string, votes string, n long, em double"
    learned = []
    for kind in KINDS:
        own = {v: float(n) for k, v, n in rows if k == kind}
        if own:
            q, _, _ = reliabilities(own)
            learned += [(kind, v, int(n), q[v]) for v, n in own.items()]
    table = spark.createDataFrame(sorted(learned), schema).coalesce(1)
    if not learned:
        return table.withColumn("p", F.lit(None).cast("double"))
    vote = [F.substring("votes", j + 1, 1) for j in range(len(LABELERS))]
    parts = [(F.col("kind") == k).cast("double") for k in KINDS]
    parts += [(v == c).cast("double") for v in vote for c in "+-"]
    featured = table.withColumn("features", array_to_vector(F.array(*parts)))
    soft = featured.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("em")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("em"))).alias("weight")),
    )).alias("s")).select("features", "s.*")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(soft)
    return model.transform(featured).select(*table.columns, vector_to_array("probability")[1].alias("p"))


def accepted(patterns: DataFrame) -> list[str]:
    """kind:votes of the patterns that the classifier takes."""
    return sorted(f"{r['kind']}:{r['votes']}" for r in patterns.where("p >= 0.5").collect())


def _added(taken: list[str]) -> Column:
    """The wide candidates of `f` whose pattern is taken, as spans."""
    allowed = F.array(*[F.lit(t) for t in taken]) if taken else F.array().cast("array<string>")
    good = F.filter("f.wide", lambda w: F.array_contains(allowed, F.concat_ws(":", w["kind"], w["votes"])))
    return F.transform(good, lambda w: F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end")))


def _sorted_spans(spans: Column) -> Column:
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.sort_array(keyed)


def _count(kind: str) -> Column:
    return F.size(F.filter("f.base", lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (array, base and added, sorted).

    NULL texts count as empty; NULL and repeated ids are rows like any other; other columns are not read; an empty table
    gives an empty result.  Offsets are code points, ends exclusive.
    """
    found = settle(docs.select(F.col(id_col).alias("id"), scan(F.col(text_col)).alias("f")))
    spans = _sorted_spans(F.concat("f.base", _added(accepted(fit(found)))))
    return found.select(
        F.col("id").alias(id_col),
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.col("f.base_sha256").alias("base_sha256"),
        spans.alias("spans"),
    )


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_text(text: str, taken: set[str]) -> str:
    """One text with its base spans and taken candidates replaced; overlapping spans are one, named by the first."""
    base = base_spans(text)
    spans = base + [(k, i, j) for k, i, j in wide_spans(text, base) if f"{k}:{votes(text, k, i, j, False)}" in taken]
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; same rows and columns, NULL texts stay NULL.

    Texts are scanned a second time beside their row, so that they are not shuffled and ids may repeat or be NULL.
    """
    found = settle(docs.select(scan(F.col(text_col)).alias("f")))
    taken = set(accepted(fit(found)))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([t if t is None else redact_text(t, taken) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, run(F.col(text_col)))
