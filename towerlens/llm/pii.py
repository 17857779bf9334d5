"""Personal data by weak supervision.

Base patterns and looser ones propose spans. Regex, gazetteer, checksum and context labelers
vote on every candidate (for, against, abstain). Spark counts vote patterns over the whole
corpus; expectation-maximisation on those counts estimates each labeler's reliability and
the chance of each pattern; a logistic classifier over votes and span shape is then trained
on the counted feature vectors, weighted by these chances. It adds candidates it is sure of
that overlap no base span; base spans always stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

KINDS = ("email", "ip", "card", "phone")
#: A candidate is added if the classifier gives it at least this chance.
SURE = 0.9
#: Characters before and after a span that context labelers read.
AROUND = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from every later digit too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    (0, re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}\s?[\[(](?:at|AT|@)[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(](?:dot|DOT)[\])])\s?[A-Za-z0-9-]{2,63}){1,4}")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])00[1-9][0-9]{0,2}[ -][0-9]{2,4}(?:[ -][0-9]{2,4}){2,3}(?![0-9])")),
)
#: Gazetteers, small and fixed: top-level names, card issuer prefixes, calling codes, private networks.
_TOP = frozenset("com org net edu gov info de fr es it uk eu io".split())
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
_CALLING = re.compile(r"(?:\+|00)(?:1|33|34|39|44|49|41|43|7|8[16]|9[018])(?![0-9])|(?:\+|00)(?:1|33|34|39|44|49)[0-9]")
_FOR = (
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b"),
    re.compile(r"(?i)\b(?:ip|host|server|address|node|client|adresse)\b"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b"),
    re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|téléphone|teléfono)\b"),
)
_AGAINST = re.compile(r"(?i)\b(?:version|release|isbn|issn|doi|order|invoice|serial|build|section|figure)\b")
LABELERS = ("strict", "checksum", "gazetteer", "context", "against", "bounds")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the email pattern, found from their ``@``."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of base matches that hold, and of those that their check drops."""
    held = [(a, 0, b) for a, b in emails(text)]
    failed = []
    for m in _IP.finditer(text):
        fine = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        (held if fine else failed).append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        number = digits_of(m[0])
        if 12 <= len(number) <= 19:
            (held if luhn(number) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                held.append((m.start(), 3, m.end()))
            else:
                failed.append((m.start(), 3, m.end()))
    return sorted(held), failed


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstain; one vote per labeler."""
    span, number = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    context = before + " " + after
    checksum = 0
    if kind == 2:
        checksum = 1 if luhn(number) else -1
    elif kind == 1 and ":" not in span:
        checksum = 1 if strict else -1
    elif kind == 3:
        checksum = 1 if 9 <= len(number) <= 15 else -1
    gazetteer = 0
    if kind == 0:
        gazetteer = 1 if re.split(r"[.\]) ]+", span)[-1].lower() in _TOP else 0
    elif kind == 1:
        gazetteer = 0 if ":" in span else -1 if span.startswith(("0.", "00")) else 1 if strict else 0
    elif kind == 2:
        gazetteer = 1 if _ISSUER.match(number) else -1
    elif kind == 3:
        gazetteer = 1 if _CALLING.match(span) else 0
    near = lambda c: c.isalnum() or c == "_"
    loose = bool(before and near(before[-1])) or bool(after and near(after[0]))
    return (1 if strict else 0, checksum, gazetteer, 1 if _FOR[kind].search(context) else 0, -1 if _AGAINST.search(before) else 0, -1 if loose else 1)


def candidates(text: str):
    """Base spans, then (start, kind, end, strict, votes, shape) of every candidate."""
    held, failed = base_spans(text)
    found = {(a, k, b): True for a, k, b in held} | {x: False for x in failed}
    if any(c in text for c in ("(", "[", ":", "-", " ", ".")):
        for kind, pattern in _LOOSE:
            if kind == 0 and "at]" not in text and "at)" not in text and "AT]" not in text and "AT)" not in text and "@]" not in text and "@)" not in text:
                continue
            if kind == 1 and text.count(":") < 7:
                continue
            for m in pattern.finditer(text):
                found.setdefault((m.start(), kind, m.end()), False)
    out = []
    for (a, k, b), strict in sorted(found.items()):
        length = min(7, (b - a) // 4)
        digits = len(digits_of(text[a:b])) * 4 // max(1, b - a)
        out.append((a, k, b, strict, votes(text, a, k, b, strict), length * 5 + digits))
    return held, out


def pattern_of(vote: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(vote))


def vote_of(pattern: int) -> np.ndarray:
    return np.array([pattern // 3**i % 3 - 1 for i in range(len(LABELERS))])


def expectation_maximisation(vote: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance that a pattern is personal data, P(vote | truth) per labeler, and the prior."""
    start = np.clip(0.5 + 0.15 * vote.sum(1), 0.05, 0.95)
    chance, table, prior = start, np.zeros((2, vote.shape[1], 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - chance) * count, chance * count])
        for truth in (0, 1):
            for value in (-1, 0, 1):
                table[truth, :, value + 1] = (weight[truth][:, None] * (vote == value)).sum(0) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (count.sum() + 2))
        log = [np.log(p) + np.log(table[truth][np.arange(vote.shape[1])[None, :], vote + 1]).sum(1) for truth, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - chance).max() < 1e-9:
            break
        chance = new
    return chance, table, prior


def features(kind: np.ndarray, vote: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """One-hot kind, votes and shape."""
    return np.concatenate([np.eye(4)[kind], (vote[:, :, None] == np.array([-1, 1])).reshape(len(vote), -1), np.eye(8)[shape // 5], np.eye(5)[np.minimum(4, shape % 5)]], 1)


def logistic(x: np.ndarray, chance: np.ndarray, count: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic classifier by Newton's steps on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weights, scale = np.zeros(x.shape[1]), count / count.sum() * min(count.sum(), 1e4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (scale * (chance - p)) - ridge * weights
        step = np.linalg.solve((x * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights


class Classifier:
    """Chance of each (kind, pattern, shape), looked up by a small table of weights."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def chance(self, kind: int, pattern: int, shape: int) -> float:
        key = (kind, pattern, shape)
        if key not in self.known:
            x = features(np.array([kind]), vote_of(pattern)[None, :], np.array([shape]))
            self.known[key] = float(1 / (1 + np.exp(-np.clip(np.append(x[0], 1) @ self.weights, -30, 30))))
        return self.known[key]


_CANDIDATE = "struct<start:bigint,kind:int,end:bigint,strict:boolean,pattern:int,shape:int>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("strict", pa.bool_()), ("pattern", pa.int32()), ("shape", pa.int32())]))


def propose(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the candidates of every whole text with votes and shape."""
    session.ship_package(docs.sparkSession)

    def run(batches):
        for batch in common.chunks(batches):
            rows = []
            for text in common.column(batch, "text").to_pylist():
                rows.append([{"start": a, "kind": k, "end": b, "strict": s, "pattern": pattern_of(v), "shape": shape} for a, k, b, s, v, shape in candidates(text or "")[1]])
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(rows, _ARROW)], ["doc_id", "found"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id long, found array<{_CANDIDATE}>")


def train(found: DataFrame) -> tuple[Classifier | None, dict]:
    """Classifier and labeler reliabilities from counted vote patterns (a bounded number of
    them: kinds x 3^6 votes x 40 shapes)."""
    counted = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.pattern", "c.shape").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "pattern", "shape").toPandas()
    if not len(counted):
        return None, {}
    vote = np.stack([vote_of(p) for p in counted["pattern"]])
    kind, count = counted["kind"].to_numpy(int), counted["n"].to_numpy(float)
    chance, tables = np.zeros(len(counted)), {}
    for k in range(len(KINDS)):
        own = kind == k
        if own.any():
            chance[own], tables[KINDS[k]], _ = expectation_maximisation(vote[own], count[own])
    weights = logistic(features(kind, vote, counted["shape"].to_numpy(int)), chance, count)
    return Classifier(weights), tables


_RESULT = ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"


def annotate(found: DataFrame, classifier: Classifier | None) -> DataFrame:
    """Base counts, base spans and all spans of each row of :func:`propose`."""
    sent = found.sparkSession.sparkContext.broadcast(classifier)
    joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(6)]
            for row in common.column(batch, "found").to_pylist():
                base = [(c["start"], c["kind"], c["end"]) for c in row if c["strict"]]
                spans = list(base)
                for c in row:
                    if c["strict"] or sent.value is None or sent.value.chance(c["kind"], c["pattern"], c["shape"]) < SURE:
                        continue
                    if all(c["end"] <= a or b <= c["start"] for a, _, b in spans):
                        spans.append((c["start"], c["kind"], c["end"]))
                for k in range(4):
                    columns[k].append(sum(x[1] == k for x in base))
                columns[4].append(joined(base))
                columns[5].append(joined(spans))
            arrays = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), *arrays], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return found.mapInArrow(run, f"doc_id long, {_RESULT}")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) per row, over whole texts.

    Spans are kind:start:end in code points, by start and then kind. Null text has none;
    repeated rows agree; an empty table stays empty and trains nothing; other columns are
    not read.
    """
    found = common.stage(propose(docs), "pii")
    return annotate(found, train(found)[0])


def query(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
