"""Language of texts and of the stretches of mixed texts.

A sentence is the average of the hashed embeddings of its letter n-grams, followed by a linear softmax. Both are trained
by stochastic gradient descent in numpy; for use they are multiplied into one table of logits per bucket. A temperature
and a rejection threshold are fitted on held-out sentences: a sentence below the threshold takes the language of the
accepted sentences beside it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl"]
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
#: At most so many documents with a label help to train, taken in the order of a hash of their id.
SAMPLE_DOCUMENTS = 1500
SAMPLE_SENTENCES = 4
#: Of a sentence with fewer known n-grams than nearly all held-out ones a language must be so likely.
SURE = 0.95
#: At most so many rows of the labelled samples are read.
SAMPLE_ROWS = 5000

#: Names and three-letter codes of the seven languages, lower case.
NAMES = {
    "en": "en eng english englisch anglais inglés inglese inglês engels",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão duits",
    "fr": "fr fra fre french français francais französisch francés francese francês frans",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo espanhol spaans",
    "it": "it ita italian italiano italienisch italien italiaans",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés olandese holandês",
}
#: Labels that name no language.
NO_LANGUAGE = ["", "?", "??", "und", "unk", "unknown", "none", "null", "n/a", "na", "mis", "mul", "zxx", "xx", "-"]


def label_language(label: Column) -> Column:
    """The code of the language that a label names by name, code or region; null when it names none; ``other`` when it
    names what is not one of the seven."""
    name = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)])
    found = F.try_element_at(known, F.trim(name))
    whole = F.lower(F.trim(label))
    return F.when(label.isNull() | whole.isin(NO_LANGUAGE), None).otherwise(F.coalesce(found, F.when(name.rlike(r"^\p{L}{2,}"), F.lit("other"))))


_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_WRAPPED = re.compile(r"(?<=[^\W\d_,])[ \t]*\r?\n(?=[^\W\d_A-ZÀ-Þ])")
_LEAD = re.compile(
    r"^[ \t]*(?:(?:[-*+•>]|\d{1,3}[.)])[ \t]+)*(?:\[[\w .-]{1,30}\][ \t]*)?"
    r"(?:(?:user|assistant|tool|system|human|agent|bot|[QA])[ \t]*:[ \t]*)?(?:\[\w{1,20}\][ \t]*)?(?:[a-z_]+\.[\w.-]+:[ \t]*)?",
)
#: A line that begins like code, data or a log has no sentences; a sentence with a mark of code is none.
_CODE = re.compile(r"\s*(?:[{}\[\]$#<|`]|[\w.]+\s*=\s*\S+;?\s*$|\d{4}-\d\d-\d\d|(?:def|import|return|SELECT|INSERT|curl|class)\b)")
_MARKED = re.compile(r"[{}<>=;()\"]")
_MARK = re.compile(r"[{}<>=;]{2}|\w\(\)|;\s*$|\":\s*[\"\d\[{]")
_STOP = re.compile(r"[.!?…]+(?:[\"'”»)\]]+|(?=\s)|\Z)")
_THREE = re.compile(r"[^\W\d_]+[\W\d_]+[^\W\d_]+[\W\d_]+[^\W\d_]")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the whole sentences of natural language in a text: three words or more, no code, without the
    role, key or list mark before them."""
    if "```" in text:
        text = _FENCE.sub(lambda m: re.sub(r"[^\n]", "\0", m[0]), text)
    if "\n" in text:
        text = _WRAPPED.sub(lambda m: " " * len(m[0]), text)
    out, at = [], 0
    for line in text.split("\n"):
        begin = _LEAD.match(line).end()
        if begin < len(line) and line[begin] != "\0" and not _CODE.match(line, begin):
            ends = [m.end() for m in _STOP.finditer(line, begin)]
            if not ends or ends[-1] < len(line):
                ends.append(len(line))
            a, marked = begin, _MARKED.search(line, begin)
            for b in ends:
                while a < b and line[a].isspace():
                    a += 1
                if b - a >= 8 and _THREE.search(line, a, b) and not (marked and _MARK.search(line[a:b])):
                    out.append((at + a, at + b))
                a = b
        at += len(line) + 1
    return out


_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Words with digits, capitals inside or at the start of names say nothing about the language.
_NOISE = re.compile(r"\([^()]*\d[^()]*\)|\"[^\"]{1,30}\"|\b[A-Z]{2,6}-\d+\b|\b\w*\d[\w.]*\b|\b\w+_\w+\b")


_NOISY = re.compile(r"[\d\"_]")


def normal(sentence: str) -> str:
    if _NOISY.search(sentence):
        sentence = _NOISE.sub(" ", sentence)
    return f" {' '.join(_LETTERS.findall(sentence.lower()))} "


def _hashes(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the buckets of the n-grams of all texts together, and where each text starts in them."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashes, begins = [], []
    for n in ORDERS:
        h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + len(h)]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = (h >> np.uint64(48)).astype(np.int64)
        keep = np.ones(len(h), bool)
        for k in range(1, n):  # those that reach into the next text
            cut = starts[1:-1] - k
            keep[cut[(cut >= 0) & (cut < len(keep))]] = False
        hashes.append(bucket[keep])
        begins.append(np.concatenate([[0], np.cumsum(np.maximum(0, lengths - n + 1))[:-1]]))
    return hashes, begins


@dataclass
class LanguageModel:
    table: np.ndarray  # logits per bucket and, last, whether the bucket was seen in training
    temperature: float
    threshold: float
    least_seen: float = 0.0

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row for each text; texts of fewer letters than the longest n-gram are padded."""
        return self.judged(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, share of the n-grams that training had) for each text."""
        out = self.averages(texts)
        z = out[:, : len(LANGUAGES)] * self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), out[:, -1]

    def averages(self, texts: list[str]) -> np.ndarray:
        """The mean row of the table over the n-grams of each text."""
        out = np.zeros((len(texts), self.table.shape[1]), np.float32)
        padded = [t if len(t) >= max(ORDERS) else t.ljust(max(ORDERS)) for t in texts]
        begin = 0
        while begin < len(padded):
            end, size = begin, 0
            while end < len(padded) and (size < 60_000 or end == begin):
                size += len(padded[end])
                end += 1
            hashes, starts = _hashes(padded[begin:end])
            total = sum(np.add.reduceat(self.table[h], s, axis=0) for h, s in zip(hashes, starts))
            count = sum(np.diff(np.append(s, len(h))) for h, s in zip(hashes, starts))
            out[begin:end] = total / count[:, None]
            begin = end
        return out


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ß", "ss")


_TWO = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


def fit(texts: list[str], langs: list[str], weights: list[int] | None = None, epochs: int = 12, seed: int = 7) -> LanguageModel:
    """Train on whole sentences; each is also shown without accents and in parts of a few words, ``weights`` times.

    Of the different sentences of weight 1 a fifth is held out before any repetition; on these, none of which was seen in
    any form, the temperature and the two rejection bounds are fitted; afterwards they are learned from as well."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, int, bool]] = []
    unique: dict[tuple[str, str], int] = {}
    for t, lang, w in zip(texts, langs, weights or [1] * len(texts)):
        unique[normal(t), lang] = unique.get((normal(t), lang), 0) + w
    alone = dict.fromkeys(plain for (plain, _), w in unique.items() if w == 1)
    held_out = {plain: i % 5 == 4 for i, plain in enumerate(alone)}
    for (plain, lang), times in unique.items():
        held = held_out.get(plain, False)
        y = LANGUAGES.index(lang)
        bare = sorted({_plain(plain), plain.translate(_TWO)} - {plain})
        words = plain.split()
        cut = int(rng.integers(0, max(1, len(words) - 4)))
        forms = [plain, f" {' '.join(words[cut : cut + 5])} "] + ([bare[int(rng.integers(0, len(bare)))]] if bare else [])
        rows += [(f, y, held) for f in forms for _ in range(1 if held else min(times, 6))]
    rows = [r for r in rows if len(r[0]) >= max(ORDERS)]
    train, test = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    E = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    V = (rng.standard_normal((DIMENSIONS, len(LANGUAGES))) * 0.3).astype(np.float32)

    def descend(shown: list[tuple[str, int, bool]], epochs: int, rate: float) -> np.ndarray:
        """Gradient steps in place; which buckets they touched."""
        hashes, begins = _hashes([r[0] for r in shown])
        ends = [np.append(s[1:], len(h)) for h, s in zip(hashes, begins)]
        labels = np.array([r[1] for r in shown])
        weight = (1 / np.maximum(1, np.bincount(labels, minlength=len(LANGUAGES))))[labels]
        weight = weight / weight.mean()
        batch = 64
        for epoch in range(epochs):
            order = rng.permutation(len(shown))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                idx = [h[s[p] : e[p]] for p in pick for h, s, e in zip(hashes, begins, ends)]
                size = np.array([len(x) for x in idx]).reshape(len(pick), -1).sum(axis=1)
                flat = np.concatenate(idx)
                owner = np.repeat(np.arange(len(pick)), size)
                mean = np.add.reduceat(E[flat], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]
                z = mean @ V
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), labels[pick]] -= 1
                g = p * (weight[pick] / len(pick))[:, None]
                step = rate * (1 - epoch / epochs)
                back = (g @ V.T) / size[:, None]
                V[:] -= step * mean.T @ g
                by = np.argsort(flat, kind="stable")
                bucket = flat[by]
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                E[bucket[first]] -= step * 20 * np.add.reduceat(back[owner[by]], first, axis=0)
        seen = np.zeros((BUCKETS, 1), np.float32)
        seen[np.concatenate(hashes)] = 1
        return seen

    seen = descend(train, epochs, 2.0)
    model = LanguageModel(np.hstack([(E @ V).astype(np.float32), seen]), 1.0, 0.5)
    if test:
        held_texts, truth = [r[0] for r in test], np.array([r[1] for r in test])
        nll = {}
        for t in (0.5, 1, 1.5, 2, 3, 4, 6):
            model.temperature = t
            p = model.probabilities(held_texts)
            nll[t] = -np.log(np.maximum(p[np.arange(len(test)), truth], 1e-9)).mean()
        model.temperature = min(nll, key=nll.get)
        p = model.probabilities(held_texts)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        for threshold in np.arange(0.4, 0.96, 0.05):  # the least at which what is accepted is right
            model.threshold = float(threshold)
            if right[best >= threshold].mean() >= 0.995:
                break
        model.least_seen = float(np.quantile(model.averages(held_texts)[:, -1], 0.002))
        # the bounds are fitted; now the held-out sentences may teach, too
        seen = np.maximum(seen, descend(train[: len(test)] + test, 2, 1.0))
        model.table = np.hstack([(E @ V).astype(np.float32), seen])
    return model


def train(samples: DataFrame, documents: DataFrame | None = None, limit: int = SAMPLE_DOCUMENTS) -> LanguageModel:
    """A model of ``samples`` (lang, sample_text), of which at most ``SAMPLE_ROWS`` are read, then one that has also learned
    from the sentences of at most ``limit`` labelled ``documents`` (doc_id, text, lang) whose label the first model
    confirms. The sentences are chosen where the documents are; only they come to the driver."""
    rows = samples.where("lang IS NOT NULL AND sample_text IS NOT NULL").orderBy("lang", "sample_text").limit(SAMPLE_ROWS).collect()
    rng = np.random.default_rng(3)
    rows = [rows[i] for i in rng.permutation(len(rows)) if rows[i]["lang"] in LANGUAGES]
    texts, langs = [r["sample_text"] for r in rows], [r["lang"] for r in rows]
    model = fit(texts, langs, epochs=25)
    if documents is None:
        return model
    picked = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where(F.col("label").isin(LANGUAGES) & F.col("text").isNotNull())
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = picked.mapInPandas(_confirmed(model), "sentence string, label string, short boolean").groupBy("sentence", "label", "short").agg(F.count(F.lit(1)).alias("n"))
    short: dict[str, Counter] = {}
    weights = [1] * len(texts)
    for r in sorted(chosen.collect()):
        if r["short"]:  # of what is said again and again the documents it stands in tell the language
            short.setdefault(r["sentence"], Counter())[r["label"]] += r["n"]
        else:
            texts, langs, weights = texts + [r["sentence"]], langs + [r["label"]], weights + [1]
    for sentence, count in sorted(short.items()):
        lang, n = count.most_common(1)[0]
        if n >= 3 and n >= 0.6 * count.total():
            texts, langs, weights = texts + [sentence], langs + [lang], weights + [6]
    order = rng.permutation(len(texts))
    return fit([texts[i] for i in order], [langs[i] for i in order], [weights[i] for i in order], epochs=5)


def _confirmed(model: LanguageModel):
    """Of each document whose label the model confirms ``SAMPLE_SENTENCES`` sentences in its language, and the short ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, label in zip(pdf["doc_id"], pdf["text"], pdf["label"]):
                spans = sentences(text)
                if not spans:
                    continue
                p = model.probabilities([normal(text[a:b]) for a, b in spans])
                total = (p * np.array([b - a for a, b in spans])[:, None]).sum(axis=0)
                y = LANGUAGES.index(label)
                if total.argmax() != y or total[y] < 0.7 * total.sum():
                    continue
                out += [(text[a:b], label, True) for a, b in spans if b - a <= 60]
                own = [i for i in np.random.default_rng(abs(int(key))).permutation(len(spans)) if p[i].argmax() == y]
                out += [(text[spans[i][0] : spans[i][1]], label, False) for i in own[:SAMPLE_SENTENCES]]
            yield pd.DataFrame(out, columns=["sentence", "label", "short"])

    return run


def stretches(model: LanguageModel, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """For each text its sentences as (start, end, language number, confidence). A sentence of which no language is likely
    enough, or that is unfamiliar and of which none is nearly sure, takes that of the accepted ones beside it. Where there are none, or where the sentences of the text together
    have too few known n-grams for any of the languages, the number is -1."""
    spans = [sentences(t) for t in texts]
    flat = [normal(t[a:b]) for t, s in zip(texts, spans) for a, b in s]
    p, seen = model.judged(flat)
    best, sure = (p.argmax(axis=1), p.max(axis=1)) if len(flat) else (np.zeros(0, int), np.zeros(0))
    out, at = [], 0
    for s in spans:
        here = slice(at, at + len(s))
        lang, c = best[here].copy(), sure[here].copy()
        good = (c >= model.threshold) & ((c >= SURE) | (seen[here] >= model.least_seen))
        if len(s) and (not good.any() or np.average(seen[here], weights=[b - a for a, b in s]) < model.least_seen):
            lang[:], c[:] = -1, 0.0
        elif not good.all():
            held = np.flatnonzero(good)
            for i in np.flatnonzero(~good):
                k = int(np.searchsorted(held, i))
                lang[i] = max((lang[held[j]] for j in (k - 1, k) if 0 <= j < len(held)), key=lambda x: p[at + i, x])
                c[i] = p[at + i, lang[i]]
        at += len(s)
        out.append([(a, b, x, y) for (a, b), x, y in zip(s, lang.tolist(), c.tolist())])
    return out


def _whole(model: LanguageModel, text: str) -> tuple[int, float]:
    """For a text without sentences, or with none that is accepted; -1 when it is rejected as a whole, too."""
    letters = normal(text)
    if not letters.strip():
        return -1, 0.0
    p, seen = model.judged([letters])
    return (int(p[0].argmax()), float(p[0].max())) if p[0].max() >= model.threshold and seen[0] >= model.least_seen else (-1, 0.0)


ADDED = {"main": "string", "confidence": "double", "mixed": "array<string>", "segments": "array<struct<start_pos:int,end_pos:int,lang:string,confidence:double>>"}


def _labelled(model: LanguageModel, text: str, wanted: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), 256):
                pdf = whole.iloc[begin : begin + 256]
                texts = [t if isinstance(t, str) else "" for t in pdf[text]]
                rows = [_summary(model, t, found, "segments" in wanted) for t, found in zip(texts, stretches(model, texts))]
                yield pdf[[c for c in pdf.columns if c not in wanted]].assign(**{name: [r[name] for r in rows] for name in wanted})

    return run


def _summary(model: LanguageModel, text: str, found: list[tuple[int, int, int, float]], merged: bool) -> dict:
    size, trust, count = [0] * len(LANGUAGES), [0.0] * len(LANGUAGES), [0] * len(LANGUAGES)
    for a, b, lang, c in found:
        if lang >= 0:
            size[lang] += b - a
            trust[lang] += (b - a) * c
            count[lang] += 1
    if any(count):
        k = max(range(len(LANGUAGES)), key=size.__getitem__)
        out = {"main": LANGUAGES[k], "confidence": trust[k] / sum(size)}
    else:
        k, c = _whole(model, text)
        out = {"main": LANGUAGES[k] if k >= 0 else None, "confidence": c}
    several = [x for x, n in zip(LANGUAGES, count) if n >= 2]
    out["mixed"] = several if len(several) > 1 else []
    if merged:
        parts: list[list] = []
        for a, b, lang, c in found:
            if parts and parts[-1][2] == lang:
                parts[-1][1:] = [b, lang, parts[-1][3] + c * (b - a), parts[-1][4] + b - a]
            else:
                parts.append([a, b, lang, c * (b - a), b - a])
        out["segments"] = [{"start_pos": a + 1, "end_pos": b, "lang": LANGUAGES[x] if x >= 0 else None, "confidence": s / n} for a, b, x, s, n in parts]
    return out


def detect(df: DataFrame, text: str, model: LanguageModel, segments: bool = True) -> DataFrame:
    """Add to each row ``main`` (the language of most characters; null for a text without letters and for one of which the
    model knows neither a sentence nor the whole), its ``confidence`` (mean probability times share of the text), ``mixed``
    (the languages with two or more whole sentences when there are two or more, else empty) and, if asked for, ``segments``
    (stretches of one language with their places, from 1, and confidence; a null language is an unknown one).

    Null and empty texts have no language, confidence 0 and no segments. Texts are read whole, repeated rows get equal
    results, columns named like the added ones are replaced.
    """
    wanted = [c for c in ADDED if segments or c != "segments"]
    df = df.select(*[c for c in df.columns if c not in wanted or c == text])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in wanted] + [f"{c} {ADDED[c]}" for c in wanted]
    return df.mapInPandas(_labelled(model, text, wanted), ", ".join(fields))
