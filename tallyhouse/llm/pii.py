"""Personal data by weak supervision: labelers vote, EM weighs, a classifier decides.

Candidate spans come from the base rules and from wider shapes. Six labelers
(shape, checksum, gazetteer, context, borders, grouping) vote yes, no or
nothing on each. How often each vote pattern occurs is counted over the whole
corpus; the table has at most ``4 * 2 * 3**6`` rows. On it,
expectation-maximisation estimates each labeler's reliability for each kind
without labels, and with it the posterior of every pattern. The final span
classifier, logistic, learns those posteriors from a bounded sample of
candidates (``SAMPLE`` of each kind, by hash). It sees the votes and, beside
them, what no labeler looks at: the words around a span, the characters next
to it and its own shape, all hashed. Base spans always stay; whether another
candidate is personal data is the classifier's word alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = 6
#: Longest stretch before a span in which context words count, and the least probability of an added span.
CONTEXT_CHARS = 32
THRESHOLD = 0.9
#: Bounds of the share of true candidates: without labels it is never known for sure.
PRIOR = (0.05, 0.95)
#: Candidates of one kind that train the classifier, at most about so many.
SAMPLE = 20_000
#: Hashed features of the classifier: words around a span, its shape, the kinds of characters next to it.
WORD_SLOTS, SHAPE_SLOTS, SIDES = 128, 32, 5
FEATURES = WORD_SLOTS + SHAPE_SLOTS + 2 * SIDES

# Gazetteers and context words of the labelers.
DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co uk us ca de fr es it nl be ch at pl pt se no dk fi eu ru cn jp in br mx ar au nz".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 358 420 421".split())
YES_WORDS = {
    "email": "mail email e-mail contact write reach courriel correo".split(),
    "ip": "ip host server address addr client dirección adresse".split(),
    "card": "card credit visa mastercard amex payment pay tarjeta carte karte".split(),
    "phone": "phone tel telephone mobile cell call fax dial teléfono téléphone telefon".split(),
}
NO_WORDS = "version release isbn issn page pages figure section id order invoice sku serial build".split()

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]{1,63}){1,4}"),
    "card": re.compile(r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![\w-])|(?<![\w.+-])00[1-9][0-9]{0,2}[\x20.-][0-9(][\x20().0-9-]{5,16}[0-9](?!\w)"),
}
_TRIGGER = re.compile(r"[0-9@]|[(\[{]at[)\]}]")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time: each is tried at its @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules: by kind as listed, then start; code points, end exclusive."""
    if not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def wide_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates, apart from the base spans and from each other."""
    if not _TRIGGER.search(text):
        return []
    taken, out = sorted((a, b) for _, a, b in base), []
    found = sorted((m.start(), -m.end(), kind) for kind, pattern in _WIDE.items() for m in pattern.finditer(text))
    end, i = -1, 0
    for a, b, kind in found:
        b = -b
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a < end or (i < len(taken) and taken[i][0] < b):
            continue
        out.append((kind, a, b))
        end = b
    return out


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """-1, 0 or 1 of each labeler for one candidate."""
    span = text[a:b]
    digits = _digits(span)
    words = [w.lower() for w in _WORD.findall(text[max(0, a - CONTEXT_CHARS) : a])][-4:]
    context = 1 if any(w in YES_WORDS[kind] for w in words) else -1 if any(w in NO_WORDS for w in words) else 0
    free = lambda c: not (c.isalnum() or c in "_@")
    border = 1 if (a == 0 or free(text[a - 1])) and (b == len(text) or free(text[b])) else -1
    if kind == "email":
        label = re.split(r"\W+", span.rstrip(")]}").lower())[-1]
        check, gazetteer, group = (1 if label.isalpha() and 2 <= len(label) <= 12 else -1), (1 if label in DOMAINS else -1), (0 if ".." in span else 1)
    elif kind == "ip":
        parts = span.split(".")
        check = 1 if all(int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if parts[0] in ("0", "127", "255") else 1
        group = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    elif kind == "card":
        check, gazetteer = (1 if luhn(digits) else -1), (1 if digits[0] in "3456" else -1)
        group = 1 if len({len(x) for x in re.split(r"[\x20-]", span)[:-1]}) <= 1 else 0
    else:
        code = digits.lstrip("0") if span.startswith("00") else digits
        check = 1 if 8 <= len(digits) <= 15 else -1
        gazetteer = (1 if any(code.startswith(c) for c in COUNTRY_CODES) else -1) if span[0] == "+" or span.startswith("00") else 0
        group = 1 if "(" in span or len(re.findall(r"[\x20.-]", span)) >= 2 else 0
    return (1 if base else 0, check, gazetteer, context, border, group)


def span_features(text: str, a: int, b: int) -> list[int]:
    """The classifier's own features of a candidate, as numbers of those that are present."""
    slot = lambda x, n: zlib.crc32(x.encode("utf-8", "surrogatepass")) % n
    before = [w.lower() for w in _WORD.findall(text[max(0, a - CONTEXT_CHARS) : a])][-3:]
    after = [w.lower() for w in _WORD.findall(text[b : b + CONTEXT_CHARS])][:2]
    shape = re.sub("[0-9]+", "9", re.sub("[^\\W\\d_]+", "a", text[a:b]))
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    found = {slot("<" + w, WORD_SLOTS) for w in before} | {slot(">" + w, WORD_SLOTS) for w in after}
    found.add(WORD_SLOTS + slot(shape, SHAPE_SLOTS))
    found.add(WORD_SLOTS + SHAPE_SLOTS + side(text[a - 1 : a]))
    found.add(WORD_SLOTS + SHAPE_SLOTS + SIDES + side(text[b : b + 1]))
    return sorted(found)


def _design(table: np.ndarray, features: list[list[int]] | None = None) -> np.ndarray:
    """One-hot votes, the classifier's own features, and a constant."""
    hot = (table[:, :, None] == np.array([-1, 0, 1])).reshape(len(table), -1)
    own = np.zeros((len(table), FEATURES))
    for row, present in zip(own, features or []):
        row[present] = 1
    return np.c_[hot, own, np.ones(len(table))].astype(float)


def _spoken(table: np.ndarray) -> np.ndarray:
    """One-hot votes of those that voted."""
    return (table[:, :, None] == np.array([-1, 0, 1])) & (table != 0)[:, :, None]


@dataclass(frozen=True)
class SpanModel:
    """Per kind: the share of true candidates, the labelers' reliabilities, and the classifier's weights."""

    prior: dict[str, float]
    reliability: dict[str, np.ndarray]  # labeler x class x vote, of those that voted
    weights: dict[str, np.ndarray]

    def posterior(self, kind: str, table: np.ndarray) -> np.ndarray:
        """What the labelers' votes say, each weighed by its reliability; who says nothing counts for nothing."""
        hot = _spoken(table)
        no, yes = self.reliability[kind][:, 0], self.reliability[kind][:, 1]
        score = np.log(self.prior[kind] / (1 - self.prior[kind])) + np.einsum("rlv,lv->r", hot, np.log(yes) - np.log(no))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def probability(self, kind: str, vote: tuple[int, ...], features: list[int] | None = None) -> float:
        """What the classifier says of a candidate."""
        if kind not in self.weights:
            return 0.0
        x = _design(np.array([vote]), [features or []]) @ self.weights[kind]
        return float(1 / (1 + np.exp(-np.clip(x[0], -30, 30))))


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> SpanModel:
    """Labelers' reliabilities by expectation-maximisation from vote counts; no classifier yet."""
    prior, reliability = {}, {}
    for kind in KINDS:
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        if not rows:
            continue
        table, n = np.array([v for v, _ in rows]), np.array([m for _, m in rows], float)
        hot = _spoken(table)
        p = 1 / (1 + np.exp(-1.5 * table.sum(axis=1) + 1.5))  # start: a majority of votes
        # smoothing leans each labeler to being right, and one that always says the same to telling nothing
        usual = np.einsum("r,rlv->lv", n, hot) + np.array([0.1, 0.0, 0.1])
        lean_yes, lean_no = usual * np.array([0.5, 1, 2]), usual * np.array([2, 1, 0.5])
        lean_yes, lean_no = (4 * x / x.sum(axis=1, keepdims=True) for x in (lean_yes, lean_no))
        for _ in range(rounds):
            share = np.clip((n * p).sum() / n.sum(), *PRIOR)
            yes = np.einsum("r,rlv->lv", n * p, hot) + lean_yes
            no = np.einsum("r,rlv->lv", n * (1 - p), hot) + lean_no
            yes, no = (np.maximum(x, 1e-9) / x.sum(axis=1, keepdims=True) for x in (yes, no))
            prior[kind], reliability[kind] = float(share), np.stack([no, yes], axis=1)
            p = SpanModel(prior, reliability, {}).posterior(kind, table)
    return SpanModel(prior, reliability, {})


def fit(counts: dict[tuple[str, tuple[int, ...]], int], sample: dict[str, Counter] | None = None) -> SpanModel:
    """Reliabilities, then the classifier from counts of (votes, features) of each kind; from the vote counts alone if there is none."""
    model, weights = reliabilities(counts), {}
    for kind in model.prior:
        if sample is None:
            rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
            table, n, own = np.array([v for v, _ in rows]), np.array([m for _, m in rows], float), None
        elif sample.get(kind):
            rows = sample[kind]
            table, n, own = np.array([v for v, _ in rows]), np.array(list(rows.values()), float), [list(f) for _, f in rows]
        else:
            continue
        p, x = model.posterior(kind, table), _design(table, own)
        w, scale = np.zeros(x.shape[1]), n / n.sum()
        penalty = np.r_[np.full(3 * LABELERS, 1e-3), np.full(FEATURES, 1e-3), 1e-4]
        for _ in range(100):  # Newton steps of the penalised likelihood
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (scale * (q - p)) + penalty * w
            h = (x * (scale * q * (1 - q))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(h, g)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        weights[kind] = w
    return SpanModel(model.prior, model.reliability, weights)


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[tuple[str, tuple[int, ...]], int]:
    """How often each kind and vote pattern occurs among all candidates of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, tuple[int, ...]]] = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                held.update((k, votes(text, k, a, b, True)) for k, a, b in base)
                held.update((k, votes(text, k, a, b, False)) for k, a, b in wide_spans(text, base))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held]), pa.array([list(v) for _, v in held], pa.list_(pa.int32())), pa.array(list(held.values()), pa.int64())], ["kind", "vote", "n"])

    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "kind string, vote array<int>, n long")
    rows = found.groupBy("kind", "vote").agg(F.sum("n").alias("n")).collect()  # at most 5,832 patterns
    return {(r.kind, tuple(r.vote)): r.n for r in rows}


def candidate_sample(docs: DataFrame, counts: dict[tuple[str, tuple[int, ...]], int], text_col: str = "text") -> dict[str, Counter]:
    """How often each (votes, features) occurs among about ``SAMPLE`` different candidates of each kind, all if there are fewer.

    They are chosen by a hash of the text around them and of the whole text, so
    that one of many copies does not bring all others; what does is counted, not listed.
    """
    total = Counter()
    for (kind, _), n in counts.items():
        total[kind] += n
    share = {kind: int(min(1.0, SAMPLE / n) * 2**32) for kind, n in total.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, list[int], list[int]]] = []
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
                for is_base, found in ((True, base), (False, wide_spans(text, base))):
                    for k, a, b in found:
                        near = f"{whole}:{k}:{a}:{text[max(0, a - CONTEXT_CHARS) : b + CONTEXT_CHARS]}"
                        if int.from_bytes(hashlib.blake2b(near.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") < share[k]:
                            out.append((k, list(votes(text, k, a, b, is_base)), span_features(text, a, b)))
            if out:
                columns = zip(*out)
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "vote", "own"])

    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "kind string, vote array<int>, own array<int>")
    # repeated candidates count as often as they stand there
    found = found.groupBy("kind", "vote", "own").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, Counter] = {}
    for r in sorted(found.collect(), key=lambda r: (r.kind, r.vote, r.own)):  # about 4 * SAMPLE rows
        out.setdefault(r.kind, Counter())[tuple(r.vote), tuple(r.own)] = r.n
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Personal data of every whole text.

    Returns id, the number of base spans of each kind, base_sha256 and spans:
    base and added spans as kind:start:end in code points. A null or empty
    text has none; repeated rows give repeated results; a corpus without
    candidates trains nothing and adds nothing; an empty table gives an empty
    result. Other columns are not read.
    """
    counts = vote_counts(docs, text_col)
    model = fit(counts, candidate_sample(docs, counts, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, shown = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = [s for s in wide_spans(text, base) if model.probability(s[0], votes(text, *s, False), span_features(text, *s[1:])) >= threshold]
                for out, kind in zip(counts, KINDS):
                    out.append(sum(k == kind for k, _, _ in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                shown.append(_joined(base + more))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
