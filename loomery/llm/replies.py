"""Defective replies: empty, truncated, refusals, copies of the question, answers in another language.

Whether a reply stops early is read from the corpus itself. Replies are sorted by text within their first characters and
compared with the next different one, which shows shortened versions; reply lengths that occur far more often than those
around them show length limits; and for each word, alone and after its predecessor, the share of its occurrences that end a
sentence or a line tells whether a reply may stop after it. All counts cover all replies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.language import LANGUAGES, LanguageModel, normal, sentences
from loomery.session import checkpoint

PREFIX = 8
#: Shorter replies can be whole and yet begin longer ones.
LEAST_WORDS = 4
#: Words and pairs with fewer occurrences tell nothing.
SEEN = 5
RARELY, SELDOM = 0.02, 0.15
#: A length limit is a length from SPIKE_FROM on that SPIKE_ROWS unfinished replies or more have.
SPIKE_FROM, SPIKE_ROWS = 60, 20
#: Replies of fewer characters and words are in the expected language if they can be.
SHORT = 60

_BLANK = r"[\s\x00-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"
#: Replies that say nothing, without punctuation and blanks, lower case.
FILLERS = [
    "", "none", "null", "nil", "nan", "na", "n/a", "tbd", "tba", "todo", "noanswer", "noresponse", "empty", "blank", "undefined", "answer", "response", "reply", "a", "antwort",
    "réponse", "respuesta", "risposta", "resposta", "antwoord", "keineantwort", "pasderéponse", "sinrespuesta", "notavailable", "notapplicable", "placeholder", "xxx", "loremipsum",
]

_HELP = r"(?:help|assist|answer|respond|reply|provide|share|give|tell|discuss|comment|advise|support|comply|fulfil\w*|offer|disclose|do (?:that|this|so)|assess|talk|go into|speak|engage|continue|process|complete|look into|take on)"
#: Who says no in each language: words of which one must be there, and how the refusal goes, in lower case.
_NO = {
    "en": (
        ["n't", "not", "unable", "refuse", "decline", "pass on", "outside", "beyond", "against my", " my "],
        rf"\b(?:i(?:'m| am)?|we) (?:\w+ ){{0,3}}?(?:cannot|can't|can not|could not|couldn't|won't|will not|not able to|unable to|not (?:allowed|permitted|authori[sz]ed) to|not going to|don't want to|do not want to)(?: \w+){{0,3}}? {_HELP}\b"
        r"|\b(?:must|have to|need to|going to|i(?:'ll| will| shall)?) (?:\w+ )?(?:decline|refuse|pass)\b|\b(?:rather|prefer|choose) not\b|\bi(?:'m| am) (?:not (?:allowed|permitted|able|authori[sz]ed)|unable)\b|\bi (?:don't|do not) (?:have (?:the )?permission|feel comfortable)"
        rf"|\b(?:outside|beyond|against) (?:of )?(?:what i \w+|my \w+)|\bmy (?:\w+ )?(?:guidelines|rules|policy|policies|instructions) (?:don't|do not|won't|forbid|prevent|prohibit)|^(?:sorry|apologies)\W+(?:\w+ )?(?:can't|cannot|won't)\b|\b(?:can't|cannot) {_HELP}(?: you)? (?:with )?(?:that|this)\b",
    ),
    "de": (
        ["nicht", "kein", "ablehn", "verweiger", "gegen mein", "außerhalb mein", "richtlinien"],
        r"\b(?:kann|darf|möchte|werde|will) ich (?:\w+,? ){0,5}nicht\b|\bich (?:kann|darf|möchte|werde|will) (?:\w+,? ){0,6}(?:nicht|keine?)\b (?:\w+ ){0,4}(?:helfen|beantworten|antworten|sagen|weiterhelfen|geben|äußern|unterstützen|besprechen|teilen|auskunft)"
        r"|\b(?:bin ich|ich bin) (?:dazu |leider )?nicht (?:befugt|berechtigt|in der lage)|\bmuss ich (?:\w+ ){0,3}(?:ablehnen|verweigern)|\bich muss (?:\w+ ){0,4}(?:ablehnen|verweigern)|\bmeine (?:richtlinien|regeln|vorgaben) (?:erlauben|lassen|verbieten)|\b(?:gegen|außerhalb) mein",
    ),
    "fr": (
        ["pas", "refuse", "déclin", "saurais", "impossible", "mes règles", "mes consignes", "mes directives"],
        r"\bje (?:ne |n')(?:peux|puis|suis|souhaite|veux|vais|dois|saurais|ai) (?:\w+ )?pas\b|\bje (?:dois|préfère|préfèrerais) (?:\w+ ){0,2}(?:refuser|décliner|ne pas)|\bje refuse|\bje ne saurais|\bil m'est impossible"
        r"|\bmes (?:règles|consignes|directives) (?:ne|m'|inter)|\bcontre mes (?:règles|consignes|directives)",
    ),
    "es": (
        ["no ", "rechaz", "declin", "niego", "negarme", "mis "],
        r"\bno (?:me )?(?:puedo|podré|debo|quiero|es posible para mí) (?:\w+ ){0,3}(?:ayudar\w*|responder\w*|contestar\w*|dar\w*|decir\w*|compartir\w*|hablar|facilitar\w*|proporcionar\w*|comentar\w*)|\bno (?:estoy autorizad|me está permitid|me es posible|tengo permiso)"
        r"|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)|\bprefiero no\b|\bme niego\b|\bmis (?:reglas|normas|directrices|pautas) (?:no|me)\b|\bcontra mis (?:reglas|normas|directrices|pautas)",
    ),
    "it pt nl": (
        ["non ", "não", "niet", "rifiut", "recusar", "weiger", "afwijz", "afslaan"],
        r"\bnon (?:posso|sono autorizzat|sono in grado|mi è (?:possibile|permesso))|\b(?:devo|dovrei) rifiutare|\bpreferisco non\b|\bnão (?:posso|consigo|estou autorizad|me é (?:possível|permitido))|\b(?:tenho de|devo) recusar|\bprefiro não\b"
        r"|\b(?:kan|mag|wil) ik (?:\w+,? ){0,5}niet\b|\bik (?:kan|mag|wil) (?:\w+,? ){0,5}niet (?:\w+ ){0,3}(?:helpen|beantwoorden|delen|zeggen)|\bmoet ik (?:\w+ ){0,2}(?:weigeren|afwijzen|afslaan)",
    ),
}
#: A reply that declines only after so many characters has said something before.
DECLINES_WITHIN = 300


def is_refusal() -> Column:
    """Whether a reply declines to answer near its beginning; one that begins with a yes or no answers. For rows of
    ``prepared``."""
    low = F.col("__low")
    said = [F.get("__hints", i) & F.regexp_instr(low, F.lit(f"(?U){pattern}")).between(1, DECLINES_WITHIN) for i, (_, pattern) in enumerate(_NO.values())]
    return F.coalesce(reduce(or_, said) & ~low.rlike(r"^(?:no|yes|sí|ja|nein|oui|non)[,.;]"), F.lit(False))


#: Names of the languages as a request has them.
_NAMED = {
    "en": "english englisch anglais inglés inglese inglês engels",
    "de": "german deutsch allemand alemán tedesco alemão duits",
    "fr": "french französisch français francés francese francês frans",
    "es": "spanish spanisch espagnol español spagnolo espanhol spaans castellano",
    "it": "italian italienisch italien italiano italiaans",
    "pt": "portuguese portugiesisch portugais portugués portoghese português portugees",
    "nl": "dutch niederländisch néerlandais neerlandés olandese holandês nederlands",
}
_LANGUAGE_OF = {name: code for code, names in _NAMED.items() for name in names.split()}
_REQUEST = re.compile(
    rf"(?i)(?:\b(?:answer|reply|respond|response|write|translate|say it|explain it|antworte\w*|antwort|schreib\w*|erkläre es|übersetz\w*|répon\w*|écri\w*|tradui\w*|respond\w*|respuesta|contest\w*|escrib\w*|traduc\w*|rispond\w*|scriv\w*|antwoord\w*)\b[^.?!]{{0,40}}?"
    rf"|\bplease |\bbitte )\b(?:in|into|auf|ins|en|em|al|au|in het)\s+(?:el |la |le |das )?({'|'.join(_LANGUAGE_OF)})\b"
)
#: Languages of which a few words can be right in each other, and the number of words from which they can't.
_ALIKE = ({"es", "pt", "it"}, {"de", "nl"})
FEW_WORDS = 7
#: Short replies of one language.
_SHORT = {"yes": "en", "yeah": "en", "oui": "fr", "non": "fr", "sí": "es", "ja": "de", "nein": "de", "sim": "pt", "não": "pt", "sì": "it", "nee": "nl"}


#: The characters of ``_BLANK``.
_BLANKS = "".join(map(chr, [*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF]))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def is_empty(text: Column) -> Column:
    """Null, without letters and digits, or a filler. Of a text with more letters than the longest filler nothing is replaced."""
    few = text.rlike(rf"^(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{0,{max(map(len, FILLERS))}}}[^\p{{L}}\p{{N}}]*$")
    bare = F.regexp_replace(F.lower(text), rf"(?:{_BLANK}|[\p{{P}}\p{{S}}])+", "")
    slash = F.regexp_replace(F.lower(text), rf"(?:{_BLANK}|[().\[\]<>:*`_-])+", "")
    return text.isNull() | F.when(few, bare.isin(FILLERS) | slash.isin(FILLERS) | ~text.rlike(r"[\p{L}\p{N}]")).otherwise(False)


def _letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def prepared(rows: DataFrame) -> DataFrame:
    """Add the forms of ``question`` and ``text`` that ``is_copy`` and ``is_refusal`` look at: columns of their own, for an
    expression that stands in several branches would be computed in each."""
    lead = F.regexp_replace("text", r"^[^:?!.]{1,24}:\s*", "")
    rows = rows.withColumn("__low", F.replace(F.lower("text"), F.lit("’"), F.lit("'")))
    return rows.withColumns({"__q": _letters(F.col("question")), "__whole": _letters(F.col("__low")), "__bare": F.when(F.substring("text", 1, 25).contains(":"), _letters(lead)), "__hints": F.array(*[reduce(or_, [F.col("__low").contains(w) for w in words]) for words, _ in _NO.values()])})


def is_copy() -> Column:
    """Only the question again, once or several times, with few changes: at most a tenth of its characters, or its end
    left out. For rows of ``prepared``."""
    q, whole, bare = F.col("__q"), F.col("__whole"), F.col("__bare")

    def same(a: Column) -> Column:
        most = F.greatest(F.lit(2), F.floor(F.length(q) * 0.18).cast("int"))
        # the bounded distance is faster, but its bound must be a constant
        distance = F.when(F.length(q) <= 1000, F.levenshtein(q, a, 180)).otherwise(F.levenshtein(q, a))
        alike = F.length(a).between(F.length(q) * 0.8 - 3, F.length(q) * 1.2 + 3) & distance.between(0, most)
        cut = q.startswith(a) & (F.length(a) >= F.length(q) * 0.5)
        return (F.length(a) > 0) & (alike | cut)

    again = whole.startswith(q) & (F.trim(F.replace(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), q), F.lit(""))) == "")
    return F.coalesce((F.length(q) > 0) & (same(whole) | ((bare != whole) & same(bare)) | again), F.lit(False))


def _found(text: Column) -> Column:
    """The words with digits masked, each with what ends a sentence or a line after it."""
    masked = F.regexp_replace(text, r"\p{N}", "9")
    return F.regexp_extract_all(masked, F.lit(r"([\p{L}\p{N}_'’/.\-]*[\p{L}\p{N}_]\)?(?:[.!?:;]+(?=\s|$|[\"”»`)])|[ \t]*\r?\n)?)"), F.lit(1))


def _word(found: Column) -> Column:
    """A word ends with a letter, digit or underscore, so what was found after it is cut off without another pattern."""
    return F.rtrim(found, F.lit(").!?:; \t\r\n"))


def _ends(found: Column) -> Column:
    return F.substring(found, -1, 1).isin(*".!?:;\n")


def _items(text: Column) -> Column:
    """The words with digits masked, each with a mark . when it ends a sentence or a line."""
    return F.transform(_found(text), lambda m: F.struct(_word(m).alias("w"), _ends(m).alias("ends")))


_OPEN = r"[(\[{,:;\-–—/&=<]$"
_CLOSED = r"[.!?。！？][\"'”»)\]*_`]*$|[\"”»`*_]$"


def _stops(texts: DataFrame) -> DataFrame:
    """For each different reply that does not end like a sentence: whether it stops early. ``text, copies, said`` ->
    ``text, truncated``. A reply's own copies count once in the statistics it is judged by. That it is ``said`` as a whole
    to that many questions counts as so many sentence ends of its last word; it weighs against these statistics only, not
    against signs in the text itself."""
    listed = texts.select("copies", _found(F.col("text")).alias("i"))
    # each beside the one before it; the last has none after it
    beside = listed.select("copies", F.inline(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "i").alias("before"), F.col("i").alias("here")))).where("here IS NOT NULL")
    pairs = beside.select("copies", F.when(~_ends(F.col("before")), _word(F.col("before"))).alias("v"), _word(F.col("here")).alias("w"), _ends(F.col("here")).alias("ends"))
    counted = checkpoint(pairs.groupBy("v", "w").agg(F.sum("copies").alias("n2"), F.sum(F.col("ends").cast("int") * F.col("copies")).alias("f2")))
    single = counted.groupBy("w").agg(F.sum("n2").alias("n1"), F.sum("f2").alias("f1")).where(F.col("n1") >= SEEN)
    double = counted.where((F.col("n2") >= SEEN) & F.col("v").isNotNull())
    beginnings = single.where(F.length("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substring("w", F.lit(1), k))).alias("w")).distinct()

    text, trails = F.col("text"), F.col("text").endswith("…") | F.col("text").endswith("...")
    cut = F.when(trails, F.regexp_replace("text", r"\s*(?:…|\.\.\.)$", "")).otherwise(text)
    # most end in a full stop, which takes no pattern
    unfinished = trails | ~(F.substring(text, -1, 1).isin(*".!?") | text.rlike(_CLOSED)) | (text.contains("```") & (F.size(F.split("text", "```")) % 2 == 0))
    open_ = checkpoint(texts.where(unfinished).withColumn("cut", cut))
    size = F.length("text")
    lengths = open_.where(size >= SPIKE_FROM).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy(F.floor(F.col("size") / 1000)).orderBy("size").rangeBetween(-6, 6)  # one row for each length
    lengths = lengths.withColumn("usual", (F.sum("n").over(around) - F.col("n")) / F.greatest(F.count("n").over(around) - 1, F.lit(1)))
    spikes = lengths.where((F.col("n") >= SPIKE_ROWS) & (F.col("n") >= 4 * F.col("usual"))).select("size", F.lit(True).alias("spike"))
    # the next different text shows the longer version, if there is any: nothing sorts between but other versions of it
    near = texts.select("text", F.substring("text", 1, PREFIX).alias("head"))
    following = near.withColumn("next", F.lead("text").over(Window.partitionBy("head").orderBy("text")))
    rest = F.substring(F.col("next"), F.length("text") + 1, F.lit(4))
    words = F.size(F.split(F.trim("text"), r"\s+"))
    goes_on = rest.rlike(r"^[\p{L}\p{N}]") | (rest.rlike(r"^[ ,]+[\p{L}\p{N}(]") & F.col("next").rlike(_CLOSED))
    shortened = following.where(F.col("next").startswith(F.col("text")) & goes_on & (words >= LEAST_WORDS)).select("text", F.lit(True).alias("shortened"))

    tail = F.substring("cut", -80, 80)  # where it has three words, the last two are whole
    last = _items(F.when(tail.rlike(r"(?s)\s\S+\s+\S"), tail).otherwise(F.col("cut")))
    asked = open_.withColumn("i", last).withColumn("w", F.try_element_at("i", F.lit(-1))["w"])
    prev = F.try_element_at("i", F.lit(-2))
    asked = asked.withColumn("v", F.when(~prev["ends"], prev["w"])).withColumn("size", size)
    asked = asked.join(single, "w", "left").join(double, ["v", "w"], "left").join(beginnings.withColumn("begins", F.lit(True)), "w", "left")
    asked = asked.withColumns({n: F.when(F.col(n) - F.col("copies") + 1 >= SEEN, F.col(n) - F.col("copies") + 1) for n in ("n1", "n2")})
    asked = asked.join(spikes, "size", "left").join(shortened, "text", "left")
    rate = F.coalesce((F.col("f2") + 0.0) / F.col("n2"), (F.col("f1") + 0.0) / F.col("n1"))
    unclosed = F.length(F.regexp_replace("cut", r"[^(]", "")) > F.length(F.regexp_replace("cut", r"[^)]", ""))
    fence = F.size(F.split("cut", "```")) % 2 == 0
    half_word = F.col("n1").isNull() & F.coalesce("begins", F.lit(False))
    lower = F.col("n1").isNull() & F.col("w").rlike(r"^\p{Ll}") & (F.length("w") > 0)
    # a longer version or a spike of the length decides, but where the last word mostly ends sentences
    proven = F.coalesce("shortened", "spike", F.lit(False)) & (F.coalesce(rate, F.lit(0.0)) < 0.5)
    inside = F.coalesce(rate < F.when(F.col("cut") != F.col("text"), SELDOM).otherwise(RARELY), F.lit(False))
    given = F.coalesce((F.col("said") >= SEEN) & (F.coalesce("f1", F.lit(0)) + F.col("said") >= SELDOM * (F.coalesce("n1", F.lit(0)) + F.col("said"))), F.lit(False))
    number = F.col("n1").isNull() & F.col("w").rlike("9") & F.col("w").rlike(r"^\p{Lu}+-9*$|^9999-9|^9+\.9+$")
    closed = F.col("cut").rlike(r"\)$")
    truncated = fence | proven | F.col("cut").rlike(_OPEN) | unclosed | (~closed & (half_word | (~given & (lower | inside | number)))) | ((F.col("cut") != F.col("text")) & (F.coalesce(rate, F.lit(0.0)) < 0.5))
    return asked.select("text", truncated.alias("truncated"))


def asked_languages(model: LanguageModel, questions: list[str]) -> list[str | None]:
    """The language that each question asks for, or is put in; None when it can't be told."""
    requests = [_REQUEST.search(q) for q in questions]
    p = model.probabilities([normal(q) for q in questions]) if questions else np.zeros((0, len(LANGUAGES)))
    return [_LANGUAGE_OF[m[1].lower()] if m else LANGUAGES[k] if x >= 0.6 else None for m, k, x in zip(requests, p.argmax(axis=1).tolist(), p.max(axis=1).tolist())]


#: What may stand between a repeated question and its answer.
_LABEL = re.compile(r"\A[\W_]*[^\W\d_][^:?!.\n]{0,23}:\s")


def reply_languages(model: LanguageModel, questions: list[str], texts: list[str], expected: list[str | None]) -> list[str | None]:
    """The language of most of each reply without the question in it; None when it can't be told. A reply of a few words
    is in the expected language if it can be at all."""
    bodies = [_LABEL.sub(" ", t.replace(q, " ").lstrip(), count=1) if q and q in t else t for q, t in zip(questions, texts)]
    spans = [sentences(b) for b in bodies]
    whole = [[(0, len(b))] if not s and len(re.findall(r"[^\W\d_]+", b)) >= 2 else s for b, s in zip(bodies, spans)]
    flat = [normal(b[x:y]) for b, s in zip(bodies, whole) for x, y in s]
    p = model.probabilities(flat) if flat else np.zeros((0, len(LANGUAGES)))
    # for each reply the characters of its accepted sentences by language
    size = np.array([y - x for s in whole for x, y in s], float) * (p.max(axis=1, initial=0) >= model.threshold)
    totals = np.zeros((len(bodies), len(LANGUAGES)))
    np.add.at(totals, np.repeat(np.arange(len(bodies)), [len(s) for s in whole]), p * size[:, None])
    most, share, whole_sum = totals.argmax(axis=1).tolist(), totals.max(axis=1).tolist(), totals.sum(axis=1).tolist()
    out: list[str | None] = []
    at = 0
    for i, (body, real, s, wanted) in enumerate(zip(bodies, spans, whole, expected)):
        own = p[at : at + 1]  # its first sentence
        at += len(s)
        if not s:
            words = re.findall(r"[^\W\d_]+", body.lower())
            out.append(_SHORT.get(words[0]) if len(words) == 1 else None)
            continue
        if not real:
            out.append(LANGUAGES[int(own[0].argmax())] if own[0].max() >= 0.9 else None)
            continue
        if len(body) < SHORT and wanted and own[0][LANGUAGES.index(wanted)] > (0.002 if len(re.findall(r"[^\W\d_]+", body)) < FEW_WORDS else 0.05):
            out.append(wanted)
            continue
        out.append(LANGUAGES[most[i]] if whole_sum[i] and share[i] >= 0.55 * whole_sum[i] else None)
    return out


def _languages(model: LanguageModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), 1000):
                pdf = whole.iloc[begin : begin + 1000]
                asked_in, number = np.unique(pdf["question"].to_numpy(str), return_inverse=True)
                known = asked_languages(model, asked_in.tolist())
                asked = [known[i] for i in number]
                spoken = reply_languages(model, pdf["question"].tolist(), pdf["text"].tolist(), asked)
                yield pd.DataFrame({"key": pdf["key"], "text": pdf["text"], "asked": asked, "spoken": spoken})

    return run


def defects(pairs: DataFrame, keys: list[str], question: str, text: str, model: LanguageModel) -> DataFrame:
    """``keys, defect`` for every defective reply: empty, copy, refusal, truncated or other_language, in this order of
    precedence. Statistics come from all replies in ``pairs``.

    A null reply is empty; a null question makes no copy and no other language. Repeated rows count once in the result.
    Texts are read whole; columns beyond those named are ignored.
    """
    rows = pairs.select(*keys, F.coalesce(F.col(question), F.lit("")).alias("question"), F.col(text).alias("raw")).distinct()
    key = F.struct(*keys)
    rows = rows.withColumn("key", key).withColumn("text", _stripped(F.col("raw")))
    first = F.when(is_empty(F.col("raw")), "empty").when(is_copy(), "copy").when(is_refusal(), "refusal")
    rows = prepared(rows).withColumn("first", first).select("key", *[k for k in keys], "question", "text", "first")
    rows = checkpoint(rows)
    stops = _stops(rows.where("first IS NULL").groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(F.xxhash64("question")).alias("said")))
    spoken = rows.where("first IS NULL AND question <> ''").select("key", "question", "text")
    other = _languages_of(spoken, model)
    joined = rows.join(stops, "text", "left").join(other, "key", "left")
    defect = F.coalesce("first", F.when(F.col("truncated"), "truncated"), F.when(F.col("other"), "other_language"))
    return joined.select(*keys, defect.alias("defect")).where("defect IS NOT NULL").distinct()


def _languages_of(spoken: DataFrame, model: LanguageModel) -> DataFrame:
    """``key, other``: whether a reply is in another language than asked for. A reply of a few words that is given again and
    again has the language in which most of its questions are asked, if the model can't tell its language or tells one in
    which such words are often the same; otherwise the model decides, however often the reply is given."""
    kind = spoken.schema["key"].dataType.simpleString()
    # the key goes through Python as JSON text
    flat = spoken.select(F.to_json("key").alias("key"), "question", "text").mapInPandas(_languages(model), "key string, text string, asked string, spoken string")
    flat = checkpoint(flat.where("asked IS NOT NULL"))
    short = flat.where(F.length("text") <= SHORT).groupBy("text", "asked").count()
    usual = short.groupBy("text").agg(F.max_by("asked", "count").alias("usual"), F.max("count").alias("most"), F.sum("count").alias("all"))
    usual = usual.where((F.col("all") >= SEEN) & (F.col("most") >= 0.6 * F.col("all"))).select("text", "usual")
    few = F.size(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))) < FEW_WORDS
    alike = reduce(or_, [F.col("usual").isin(*group) & F.col("spoken").isin(*group) for group in _ALIKE])
    out = flat.join(usual, "text", "left").withColumn("spoken", F.when(F.col("spoken").isNull() | (few & alike), F.coalesce("usual", "spoken")).otherwise(F.col("spoken")))
    return out.select(F.from_json("key", kind).alias("key"), (F.col("spoken") != F.col("asked")).alias("other"))
