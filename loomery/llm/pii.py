"""Personal information in free text: a skip-chain conditional random field over the words of a text.

Each word has a label: none, email, phone, identity number, address or name. Neighbouring words share a potential, and so
do the occurrences of one word in a document, however far apart: the label that one mention gets from its context reaches
the others. Marginals come from loopy message passing, vectorised in numpy over all words of a batch. The weights are
trained by pseudo-likelihood on sentences of a grammar (``pii_training``).

The field reads every text as a whole, whatever words it holds. Found spans are trimmed and checked for form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import pii_training
from loomery.llm.language import sentences

LABELS = "OEPIAN"
TYPES = {"E": "email", "P": "phone", "I": "id_number", "A": "address", "N": "name"}
L = len(LABELS)
WINDOW = 3
ROUNDS = 6
#: How much ordinary text is read for training.
BACKGROUND_TEXTS, BACKGROUND_SENTENCES = 1500, 3
#: A detail left in a text is worse than a word too many taken out: marginals are weighed so against those of no detail.
LEAN = np.array([1.0, 2.0, 2.0, 4.0, 2.0, 8.0])

_KIND_WORDS = "street st road rd avenue ave lane ln drive court close row way place square boulevard terrace rue chemin quai calle avenida plaza paseo via viale piazza rua travessa allee am"
_KIND_ENDS = r"\w{2,}(?:straße|strasse|str|weg|allee|gasse|platz|ufer|damm|straat|laan)"
_TITLES = "dr mr mrs ms frau herr prof m mme monsieur madame señor señora sr sra miss"
_PARTS = "von van der de della di da du del des la le y of"
_UNITS = "flat apt apartment suite piso bajo unit"

#: An email address, also spelled out.
_AT = r"(?:@| @ |\s?[(\[]at[)\]]\s?)"
_DOT = r"(?:\.|\s?[(\[]dot[)\]]\s?)"
EMAIL = rf"[\w.+\-]*\w(?:{_AT}[^\W_][\w\-]*(?:{_DOT}[^\W_][\w\-]*)*{_DOT}[^\W\d_]{{2,}}| at [^\W_][\w\-]*(?: dot [^\W_][\w\-]*)* dot [^\W\d_]{{2,}})"
#: A run of numbers as phones and identity numbers have it.
NUMBER = r"(?:\+|\((?=\d{2,4}\))|\b[A-Z]{1,3}|\b[A-Z]{2} (?=\d\d \d\d \d\d [A-Z]\b))?\d+(?:[ .\-/()]{1,2}\d+)*(?:[- ]?[A-Z]\b)?"

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\n|[^\w\s]|_")
_EMAIL, _NUMBER = re.compile(EMAIL), re.compile(NUMBER)


def _shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 12)}{w[0] if w[0] in '09' else ''}"
    if not w[0].isalpha():
        return w
    if len(w) == 1:
        return "A" if w.isupper() else "a"
    return "UP" if w.isupper() else "Cap" if w[0].isupper() and w[1:].islower() else "low" if w.islower() else "Mix"


def _run_shape(run: str) -> str:
    out = re.sub(r"\d+", lambda m: str(min(len(m[0]), 12)), re.sub(r"[A-Z]", "A", run))
    first = re.search(r"\d", run)[0]
    return f"{out}:{first if first in '09' else ''}"


class Encoder:
    """Feature numbers of words and number runs; those not seen in training share a number."""

    def __init__(self, given: list[str]) -> None:
        self.words: dict[str, int] = {"": 0}
        self.ends: dict[str, int] = {"": 0}
        self.shapes: dict[str, int] = {"": 0}
        self.runs: dict[str, int] = {"": 0, "?": 1, "EMAIL": 2}
        self.lexicon: dict[str, int] = {}
        for k, group in enumerate((_KIND_WORDS, _TITLES, _PARTS, _UNITS), start=2):
            self.lexicon |= {w: k for w in group.split()}
        self.lexicon |= {g.lower(): 1 for g in given}
        self.street = re.compile(_KIND_ENDS + r"$")
        self.frozen = False

    def _number(self, table: dict[str, int], key: str) -> int:
        if self.frozen:
            return table.get(key, 0)
        return table.setdefault(key, len(table))

    def word(self, w: str) -> tuple[int, int, int, int]:
        low = w.lower()
        lex = self.lexicon.get(low, 0) or (6 if len(low) > 4 and self.street.match(low) else 0)
        known = 0 if lex == 1 else self._number(self.words, low)
        return known, self._number(self.shapes, _shape(w)), lex, self._number(self.ends, low[-3:]) if len(w) > 3 and w[0].isalpha() and lex != 1 else 0

    def run(self, run: str) -> int:
        return self.runs.get(key, 1) if self.frozen and (key := _run_shape(run)) else self._number(self.runs, _run_shape(run))


LEX = 8
SIZES = ("words", "shapes", "lex", "ends")


@dataclass
class Batch:
    """The words of many texts one after the other; ``seq`` numbers the text, and so the chain, that a word stands in."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    seq: np.ndarray
    word: np.ndarray  # number in ``unique``
    unique: list[str]
    run: np.ndarray
    skip_a: np.ndarray
    skip_b: np.ndarray


#: What an email address has after its local part, and what that part is made of.
_SIGN = re.compile(r" ?@|\s?[(\[]at[)\]]| at [^\W_][\w\-]*(?: dot [^\W_][\w\-]*)* dot ")


def emails(text: str) -> list[tuple[int, int]]:
    """Places of email addresses: looked for around their sign, not at every word."""
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        least = out[-1][1] if out else 0
        begin = m.start()
        while begin > least and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
            begin -= 1
        found = _EMAIL.match(text, begin) if begin < m.start() else None
        if found and found.end() > m.start():
            out.append(found.span())
    return out


def read(texts: list[str], encoder: Encoder) -> Batch:
    """The texts are read as one, with gaps that no pattern reaches over."""
    gap = "\t\t\t"
    whole = gap.join(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) + len(gap) for t in texts])[:-1]]).astype(np.int64) if texts else np.zeros(1, np.int64)
    runs = [(a, b, 2) for a, b in emails(whole)]
    taken, k = runs[:], 0
    for m in _NUMBER.finditer(whole):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= 3 and not (k < len(taken) and taken[k][0] < b):
            runs.append((a, b, encoder.run(m[0])))
    runs.sort()
    words = _TOKEN.findall(whole)
    places = np.array([m.span() for m in _TOKEN.finditer(whole)], np.int64).reshape(-1, 2)
    of_a = np.searchsorted(begins, places[:, 0], side="right") - 1
    start, end = places[:, 0] - begins[of_a], places[:, 1] - begins[of_a]
    run = np.zeros(len(words), np.int64)
    if runs:
        table = np.array(runs, np.int64)
        at = np.searchsorted(table[:, 1], places[:, 0], side="right")
        inside = (at < len(table)) & (table[np.minimum(at, len(table) - 1), 0] <= places[:, 0])
        run[inside] = table[at[inside], 2]
    word, unique = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, int), [])
    # repeated words of a document: each occurrence is linked to the next
    low, _ = pd.factorize(np.array([w.lower() if len(w) > 3 and w[0].isalpha() else "" for w in unique], dtype=object)) if words else (np.zeros(0, int), [])
    long = np.array([len(w) > 3 and w[0].isalpha() and not w.islower() for w in unique], bool)
    at = np.flatnonzero(long[word]) if words else np.zeros(0, int)
    key = of_a[at] * (len(unique) + 1) + low[word[at]] if words else at
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(np.diff(key[order]) == 0)
    return Batch(of_a, start, end, of_a, word, list(unique), run, at[order[same]], at[order[same + 1]])


@dataclass
class Field:
    encoder: Encoder
    tables: dict[str, np.ndarray]  # per feature kind: (number, offset, label)
    run: np.ndarray  # (number, offset, label)
    chain: np.ndarray
    skip: np.ndarray
    bias: np.ndarray

    def unary(self, b: Batch) -> np.ndarray:
        n = len(b.word)
        codes = np.array([self.encoder.word(w) for w in b.unique], np.int64).reshape(-1, 4)
        whole = sum(self.tables[k][codes[:, j]] for j, k in enumerate(SIZES)).astype(np.float32)
        run = self.run.astype(np.float32)
        out = np.tile(self.bias.astype(np.float32), (n, 1))
        for o in range(-WINDOW, WINDOW + 1):
            lo, hi = max(0, -o), min(n, n - o)
            if lo >= hi:
                continue
            other = b.seq[lo:hi] != b.seq[lo + o : hi + o]
            part = whole[:, o + WINDOW][b.word[lo + o : hi + o]]
            if abs(o) <= 1:
                part += run[:, o + 1][b.run[lo + o : hi + o]]
            part[other] = 0
            out[lo:hi] += part
        return out

    def marginals(self, b: Batch) -> np.ndarray:
        """Loopy sum-product: messages along the chain and the skips, all at once in every round. A word is linked to at most
        the next and the last one like it, so no message is added up; all are normalised, so none needs a logarithm."""
        u = self.unary(b)
        n = len(u)
        if not n:
            return u
        own = np.exp(np.maximum(u - u.max(axis=1, keepdims=True), -40))
        ends = np.flatnonzero(b.seq[1:] != b.seq[:-1])
        right, left = np.ones((n, L), np.float32), np.ones((n, L), np.float32)  # to a word from its left, from its right
        to_b, to_a = np.ones((len(b.skip_a), L), np.float32), np.ones((len(b.skip_a), L), np.float32)
        chain, back, skip = (np.exp(x).astype(np.float32) for x in (self.chain, self.chain.T, self.skip))

        one = np.ones((L, 1), np.float32)

        def normed(message: np.ndarray) -> np.ndarray:
            message /= message @ one + np.float32(1e-30)
            message += np.float32(1e-12)
            return message

        for turn in range(ROUNDS + 1):
            base = own.copy()
            base[b.skip_b] *= to_b
            base[b.skip_a] *= to_a
            if turn == ROUNDS:
                break
            onward, backward = base * right, base * left
            full = onward[b.skip_a] * left[b.skip_a], onward[b.skip_b] * left[b.skip_b]
            right[1:], left[:-1] = normed(onward[:-1] @ chain), normed(backward[1:] @ back)
            right[ends + 1], left[ends] = 1, 1
            if len(to_b):
                to_b, to_a = normed(np.maximum(full[0] / to_a, 1e-30) @ skip), normed(np.maximum(full[1] / to_b, 1e-30) @ skip)
        z = base * right * left
        return z / z.sum(axis=1, keepdims=True)


def train(given: list[str] | None = None, count: int = 5000, epochs: int = 10, seed: int = 11, background: list[str] | None = None) -> Field:
    """Pseudo-likelihood: every word's label given its features, its neighbours' labels and those of its repetitions.

    The sentences with details are those of ``pii_training``; between them stand sentences of ``background``, in which what
    is ordinary in the texts to be read is learned. They are taken to have no details."""
    given = given or [*pii_training.GIVEN, *pii_training.MORE_GIVEN]
    docs = pii_training.documents(count, seed, background)
    encoder = Encoder(given)
    b = read([t for t, _ in docs], encoder)
    n = len(b.word)
    y = np.zeros(n, np.int64)
    first = np.searchsorted(b.text, np.arange(len(docs) + 1))
    for i, (_, spans) in enumerate(docs):
        for s, e, kind in spans:
            lo, hi = np.searchsorted(b.start[first[i] : first[i + 1]], [s, e]) + first[i]
            y[lo:hi] = LABELS.index(kind)
    codes = np.array([encoder.word(w) for w in b.unique], np.int64)
    rng = np.random.default_rng(seed)
    for j in (0, 3):  # words seen once are as good as unknown
        count_of = np.bincount(codes[:, j], weights=np.bincount(b.word, minlength=len(codes)), minlength=codes[:, j].max() + 1)
        codes[:, j] = np.where(count_of[codes[:, j]] < 3, 0, codes[:, j])
    encoder.frozen = True
    sizes = (len(encoder.words), len(encoder.shapes), LEX, len(encoder.ends))
    field = Field(encoder, {k: np.zeros((s, 2 * WINDOW + 1, L)) for k, s in zip(SIZES, sizes)}, np.zeros((len(encoder.runs), 3, L)), np.zeros((L, L)), np.zeros((L, L)), np.zeros(L))
    linked = np.concatenate([[False], b.seq[1:] == b.seq[:-1]])
    pairs = np.concatenate([np.stack([b.skip_a, b.skip_b], 1), np.stack([b.skip_b, b.skip_a], 1)]) if len(b.skip_a) else np.zeros((0, 2), int)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    square: dict[str, np.ndarray] = {}

    def step(name: str, table: np.ndarray, index: tuple, grad: np.ndarray, rate: float) -> None:
        total = np.zeros_like(table)
        np.add.at(total, index, grad)
        g2 = square.setdefault(name, np.full(table.shape, 1e-3))
        total += 2e-3 * np.sign(table) * (np.abs(total) > 0)
        g2 += total * total
        table -= rate * total / np.sqrt(g2)

    owners = rng.permutation(len(docs))
    for epoch in range(epochs):
        for part in np.array_split(owners, 12):
            chosen = np.zeros(len(docs), bool)
            chosen[part] = True
            t = np.flatnonzero(chosen[b.text])
            z = np.tile(field.bias, (len(t), 1))
            places = []
            for o in range(-WINDOW, WINDOW + 1):
                at = t + o
                ok = (at >= 0) & (at < n)
                ok[ok] = b.seq[at[ok]] == b.seq[t[ok]]
                k = np.flatnonzero(ok)
                places.append((o, k, at[k]))
                w = codes[b.word[at[k]]]
                for j, name in enumerate(SIZES):
                    z[k] += field.tables[name][w[:, j], o + WINDOW]
                if abs(o) <= 1:
                    z[k] += field.run[b.run[at[k]], o + 1]
            before = np.flatnonzero(linked[t])
            z[before] += field.chain[y[t[before] - 1]]
            after = np.flatnonzero(np.concatenate([linked[1:], [False]])[t])
            z[after] += field.chain[:, y[t[after] + 1]].T
            lo, hi = np.searchsorted(pairs[:, 0], t), np.searchsorted(pairs[:, 0], t, side="right")
            far = np.repeat(np.arange(len(t)), hi - lo)
            other = pairs[np.concatenate([np.arange(a, c) for a, c in zip(lo, hi) if c > a] or [np.zeros(0, int)]).astype(int), 1]
            np.add.at(z, far, field.skip[y[other]])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(t)), y[t]] -= 1
            rate = 0.25 * (1 - epoch / epochs) + 0.02
            for o, k, at in places:
                w = codes[b.word[at]]
                for j, name in enumerate(SIZES):
                    step(f"{name}{o}", field.tables[name][:, o + WINDOW], (w[:, j],), p[k], rate)
                if abs(o) <= 1:
                    step(f"run{o}", field.run[:, o + 1], (b.run[at],), p[k], rate)
            step("chain", field.chain, (y[t[before] - 1],), p[before], rate)
            step("chain2", field.chain.T, (y[t[after] + 1],), p[after], rate)
            step("skip", field.skip, (y[other],), p[far], rate)
            step("bias", field.bias, (slice(None),), p.sum(axis=0), rate)
    # a rare word is unknown from now on
    for j, table in ((0, encoder.words), (3, encoder.ends)):
        kept = set(codes[:, j].tolist())
        for key in [k for k, v in table.items() if v not in kept]:
            del table[key]
    field.skip = (field.skip + field.skip.T) / 2
    return field


def background(texts: DataFrame, text: str, key: str, limit: int = BACKGROUND_TEXTS) -> list[str]:
    """Sentences of ordinary text: at most ``BACKGROUND_SENTENCES`` of each of at most ``limit`` texts, in the order of a
    hash of the key. Those with an @ or a digit are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for t in pdf["t"]:
                plain = [t[a:b] for a, b in sentences(t) if not re.search(r"[@\d]", t[a:b])]
                kept += plain[:: max(1, len(plain) // BACKGROUND_SENTENCES)][:BACKGROUND_SENTENCES]
            yield pd.DataFrame({"sentence": kept})

    picked = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(key).alias("h")).orderBy("h", "t").limit(limit)
    return sorted({r["sentence"] for r in picked.select("t").mapInPandas(run, "sentence string").collect()})


_TITLE = re.compile(rf"(?:(?:{'|'.join(t for t in _TITLES.split() if len(t) > 1)})\.?\s+)+(?=[^\W\d_]{{2,}}|[^\W\d_]\.)", re.I)


def _trimmed(text: str, a: int, b: int, given: set[str], ordinary: dict[str, int]) -> tuple[int, int]:
    """A name without ordinary words at its ends: small ones beside capitals, and a known word before a given name."""
    while first := re.match(r"([^\W\d_]+)\s+(?=([^\W\d_]+))", text[a:b]):
        w, then = first[1], first[2]
        small = w.islower() and w not in _PARTS.split() and any(c.isupper() for c in text[a:b])
        if w.lower() in given or not (small or (len(w) > 1 and w.lower() in ordinary and then.lower() in given)):
            break
        a += first.end()
    while last := re.search(r"\s+([^\W\d_]+)\Z", text[a:b]):
        w = last[1]
        if w.lower() in given or not w.islower() or not (len(w) == 1 or any(c.isupper() for c in text[a:b])):
            break
        b = a + last.start()
    return a, b


def checked(text: str, a: int, b: int, kind: str, sure: float, given: set[str], ordinary: dict[str, int]) -> tuple[int, int] | None:
    """The span without what doesn't belong to it, or None when it has not the form of its type."""
    s = text[a:b]
    if kind == "E":
        found = [m for m in _EMAIL.finditer(text, max(0, a - 80), min(len(text), b + 80)) if m.start() < b and a < m.end()]
        return found[0].span() if found else None
    if kind in "PI":  # the whole run of numbers that most of the span lies in
        runs = [m for m in _NUMBER.finditer(text, max(0, a - 25), min(len(text), b + 25)) if m.start() < b and a < m.end()]
        m = max(runs, key=lambda m: min(b, m.end()) - max(a, m.start()), default=None)
        digits = sum(c.isdigit() for c in m[0]) if m else 0
        return (m.start(), m.end()) if m and (7 if kind == "P" else 6) <= digits <= 15 else None
    lead = len(s) - len(s.lstrip(" \n\t\r,;:.|<>()\"'-–{}"))
    tail = len(s) - len(s.rstrip(" \n\t\r,;:.|<>()\"'-–{}"))
    a, b = a + lead, b - tail
    if b <= a:
        return None
    if kind == "N":
        m = _TITLE.match(text[a:b])
        if m:
            a += m.end()
        a, b = _trimmed(text, a, b, given, ordinary)
        words = re.findall(r"[^\W\d_]+", text[a:b])
        before = re.search(r"([^\W\d_]+) $", text[max(0, a - 20) : a])
        if before and len(before[1]) > 1 and before[1][0].isupper() and (before[1].lower() in given or before[1].lower() not in ordinary and before[1].lower() not in _TITLES.split()):
            a -= len(before[1]) + 1
            words.append(before[1])
        capital = all(w[0].isupper() or w in _PARTS for w in words)
        listed = any(w.lower() in given for w in words)
        if any(c.isdigit() for c in text[a:b]) or not (listed or (len(words) > 1 and (capital or sure > 0.85)) or (capital and sure > 0.8)):
            return None
        return (a, b) if b - a >= 2 else None
    number = re.search(r"(?<![\w.,/-])\d{1,4}(?: ?[a-zA-Z])?,? \Z", text[max(0, a - 9) : a])
    if number and not text[a].isdigit():  # the house number before the street
        a = max(0, a - 9) + number.start()
    words = re.findall(r"[^\W\d_]{2,}", text[a:b])
    return (a, b) if len(words) >= 2 and any(c.isdigit() for c in text[a:b]) else None


def find(field: Field, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """For each text its personal details in order: (start, end, label, probability)."""
    b = read(texts, field.encoder)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    p = field.marginals(b)
    label = (p * LEAN).argmax(axis=1) if len(p) else np.zeros(0, int)
    given = {w for w, k in field.encoder.lexicon.items() if k == 1}
    hit = np.flatnonzero(label)
    begin = None
    for j, t in enumerate(hit):
        if begin is None:
            begin = t
        follows = j + 1 < len(hit) and hit[j + 1] == t + 1 and b.seq[t + 1] == b.seq[t] and label[t + 1] == label[t]
        if follows:
            continue
        kind, i = LABELS[label[t]], int(b.text[t])
        span = (int(b.start[begin]), int(b.end[t]))
        gap = out[i] and texts[i][out[i][-1][1] : span[0]]
        if kind == "A" and out[i] and out[i][-1][2] == "A" and len(gap) <= 3 and not gap.strip(" ,\n."):
            last = out[i].pop()
            span = (last[0], span[1])
        sure = float(p[begin : t + 1, label[t]].mean())
        good = checked(texts[i], *span, kind, sure, given, field.encoder.words)
        if good and not (out[i] and out[i][-1][:3] == (*good, kind)):
            out[i].append((*good, kind, sure))
        begin = None
    return out


FOUND = "array<struct<pii_type:string,start_pos:int,end_pos:int,confidence:double>>"


def _marked(field: Field, cleaned: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), 2000):
                pdf = whole.iloc[begin : begin + 2000]
                texts = [t if isinstance(t, str) else "" for t in pdf["__text"]]
                spans = find(field, texts)
                found = [[{"pii_type": TYPES[k], "start_pos": a + 1, "end_pos": b, "confidence": c} for a, b, k, c in s] for s in spans]
                out = pdf.drop(columns="__text").assign(__found=found)
                yield out.assign(__clean=[replaced(t, s) if s else None for t, s in zip(texts, spans)]) if cleaned else out

    return run


def replaced(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with a typed placeholder for each span."""
    at, parts = 0, []
    for a, b, k, _ in spans:
        if a >= at:
            parts += [text[at:a], f"[{TYPES[k].upper()}]"]
            at = b
    return "".join([*parts, text[at:]])


def details(df: DataFrame, text: str, field: Field) -> DataFrame:
    """``redact`` without the texts: the other columns of ``df`` and ``pii``."""
    df = df.select(*[c for c in df.columns if c not in ("pii", text)], F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "__text")
    return df.mapInPandas(_marked(field, False), f"{fields}, __found {FOUND}").withColumnRenamed("__found", "pii")


def redact(df: DataFrame, text: str, field: Field) -> DataFrame:
    """Add ``pii`` (type, start and end place from 1, confidence of every personal detail) and ``redacted`` (the text
    with typed placeholders such as [EMAIL], otherwise unchanged).

    Null texts give an empty ``pii`` and a null ``redacted``; repeated rows equal results; texts are read whole; columns
    named like the added ones are replaced.
    """
    df = df.select(*[c for c in df.columns if c not in ("pii", "redacted")])
    marked = df.withColumn("__text", F.col(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = marked.mapInPandas(_marked(field, True), f"{fields}, __found {FOUND}, __clean string")
    return out.select(*df.columns, F.col("__found").alias("pii"), F.coalesce("__clean", F.col(text)).alias("redacted"))
