"""Problem 10: pages of repeated keywords, link lists or product tags instead of sentences.

A page is a sequence of units (lines; long lines in pieces). A hidden Markov model labels each
unit as prose, record, link list, tag list or menu from a few discretised features; a page whose
words lie for the greater part in link lists, tag lists and menus is flagged. The model is fitted
by fit() on a bounded sample of documents whose units a few cautious rules label where they are
sure; its parameters lie beside this module.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import spread

STATES = ("prose", "record", "link list", "tag list", "menu")
SPAM = (2, 3, 4)
#: Texts of fewer words are no case; a page is flagged beyond this share of non-prose words.
LEAST_WORDS, SHARE = 15, 0.5
#: Documents on which the model is fitted at most.
SAMPLE = 20_000
PARAMETERS = Path(__file__).with_name("line_hmm.json")
#: Words of a unit at most; a longer line is cut at sentence ends, else after so many words.
UNIT = 28
#: Words from which on a unit counts in full.
WEIGHTY = 10

#: Function words of the five languages. Fixed values.
FUNCTION_WORDS = frozenset(
    """a about above across after against all along although among an and any are as at be because been before below beside besides between beyond
    but by can could despite does during each either every for from had has have her his how if in inside instead into is it its me more most my
    nor not of off on once only or our out over per shall she should since so some such than that the their them then there these they this those
    through to toward under until up upon was we were what when where whereas which while who will with within without would you your
    aber alle als am an auf aus außerhalb bei bis das dass dem den der des die durch ein eine einem einen einer eines er es für gegen gemäß hat
    ihr im in innerhalb ist jede jeder jedes mit nach nicht noch nur oder ohne seit sich sie sind sowie statt trotz über um und unter vom von vor
    während wegen werden wird wie zu zum zur
    à ainsi après au aux avant avec car ce ces cette chaque contre dans de depuis des du elle en entre est et eux hors il ils la le les leur leurs
    lors mais malgré ne ni nos notre nous ou par parmi pas pendant pour puis que qui sans selon ses si son sous sur un une vers vos votre vous
    al ante antes bajo con contra cuando de del desde donde durante e el ella en entre es ese esta este está fuera ha hacia hasta la las lo los más
    ni no o para pero por porque que se según ser si sin sobre son su sus tras u un una unas unos y
    אבל אחרי אחר אין אל אם אני אנחנו או את בגלל בין בלי במהלך במקום גם הוא היא הם זה זו זאת יש כדי כי כל כמו כן לא לאחר לפי לפני למרות מאז מול מחוץ
    מן מתוך נגד עבור עד על עם של שם תוך תחת""".split()
)

_WORDS = re.compile(r"\w+")
_LINK = re.compile(r"h(?:tt|xx)ps?(?::/|\[:\])|\bwww\.", re.IGNORECASE)
_ADDRESS = re.compile(r"(?:h(?:tt|xx)ps?(?::/|\[:\])|\bwww\.)[^\s|)]*", re.IGNORECASE)
_CODE = re.compile(r"[^\W\d_]*\d[\w/-]*")
_PRICE = re.compile(r"\d[.,]\d\d\b\W*(?:eur|usd|gbp|chf|€|\$|£)", re.IGNORECASE)
#: Labels of article numbers, before a number. Fixed values.
_ARTICLE_NO = re.compile(r"\b(?:SKU|EAN|GTIN|UPC|MPN|ASIN|ISBN|P/N)\b[\s:.#-]*[A-Z]*[\s-]*\d")
_TAG = re.compile(r"(?:^|\s)#\w")
_NUMBERED = re.compile(r"^\W*\d+(?:\.\d+)*[.)\]]?\s+(?=\D)")
_HEBREW = re.compile("[א-ת]")
#: A Hebrew word with its article.
_ARTICLE = re.compile(r"\bה[א-ת]{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_DIGIT = re.compile(r"\d")
_SEPARATORS = ("|", "/", ";", "•", "·", "»", ",", " - ", " – ", " — ")
#: Cuts between the buckets of each feature. Fixed values.
CUTS = {"links": (0.001, 0.05, 0.12), "function": (0.04, 0.12, 0.22), "repeat": (0.15, 0.32, 0.5), "page": (0.2, 0.45, 0.7), "separators": (0.08, 0.2, 0.35), "codes": (0.001, 0.15, 0.3)}
FEATURES = (*CUTS, "sentence", "record", "tags")
_CUTS, _ENDS = tuple(CUTS.values()), tuple(".?!…")


def units(text: str) -> list[str]:
    """The page's units, in order: lines, long ones in pieces; blank lines give none."""
    out: list[str] = []
    for line in text.splitlines():
        n = line.count(" ") + 1
        if n <= UNIT:
            if _WORDS.search(line):
                out.append(_NUMBERED.sub("", line))
            continue
        held: list[str] = []
        first = len(out)
        for sentence in _SENTENCE.split(line):
            held += sentence.split()
            if len(held) >= UNIT // 3:
                out += [" ".join(held[i : i + UNIT]) for i in range(0, len(held), UNIT)]
                held = []
        if held and len(out) > first:
            out[-1] += " " + " ".join(held)
        elif held:
            out.append(" ".join(held))
    return out


def features(page: list[str]) -> tuple[list[int], list[tuple[int, ...]]]:
    """(words, buckets of the features) of every unit."""
    words = [_WORDS.findall(unit.lower()) for unit in page]
    count = Counter(chain.from_iterable(words))
    hebrew = any(map(_HEBREW.search, page))
    often = max(4, 0.04 * sum(map(len, words)))
    frequent = {w for w, c in count.items() if c >= often and len(w) > 2 and w not in FUNCTION_WORDS}
    sizes, rows = [], []
    for line, own in zip(page, words):
        n = len(own)
        sizes.append(n)
        m = n or 1
        links = len(_LINK.findall(line)) if ":" in line or "." in line else 0
        if links:  # what an address is made of says nothing beyond the link
            line = _ADDRESS.sub(" ", line)
        digits = _DIGIT.search(line) is not None
        function = (len([w for w in own if w in FUNCTION_WORDS]) + (len(_ARTICLE.findall(line)) if hebrew else 0)) / m
        commas = line.count(",")
        tight = commas >= 3 and commas - line.count(", ") >= 3 or line.count("\t") >= 2 or line.count(";") >= 3 and "; " not in line
        value = (
            links / m,
            function,
            1 - len(set(own)) / m if n > 3 else 0.0,
            len([w for w in own if w in frequent]) / m if frequent else 0.0,
            sum(map(line.count, _SEPARATORS)) / m,
            (len(_CODE.findall(line)) + 2 * len(_PRICE.findall(line))) / m if digits else 0.0,
        )
        rows.append(
            (
                *map(bisect_right, _CUTS, value),
                int(n >= 5 and line.rstrip()[-1:] in _ENDS and function > 0.1),
                int(tight and not links),
                int(digits and _ARTICLE_NO.search(line) is not None or "#" in line and 2 * len(_TAG.findall(line)) >= m),
            )
        )
    return sizes, rows


def sure_label(f) -> int | None:
    """Label of a unit where its features leave no doubt; for fitting only."""
    links, function, repeat, page, separators, codes, sentence, record, tags = f
    if record:
        return 1
    if tags or (links and codes >= 2 and function == 0):
        return 3
    if function >= 2 and repeat < 2:
        return 0
    if links >= 2 and function <= 1:
        return 2
    if function <= 1 and (repeat >= 2 or (page >= 2 and separators >= 1) or page == 3):
        return 4
    return None


def fit(pages: list[str], rounds: int = 4) -> dict:
    """Start, transition and emission log-probabilities: counted on the sure units, then re-estimated on all (Baum-Welch)."""
    k, n = len(STATES), 4
    start, move, emit = np.ones(k), np.ones((k, k)), np.ones((len(FEATURES), k, n))
    observed = [features(u) for u in map(units, pages) if u]
    for _, obs in observed:
        before = None
        for f in obs:
            s = sure_label(f)
            if s is not None:
                for j, b in enumerate(f):
                    emit[j, s, b] += 1
                if before is None:
                    start[s] += 1
                else:
                    move[before, s] += 1
            before = s if s is not None else before
    model = _logs(start, move, emit)
    for _ in range(rounds):
        model = re_estimated(model, observed)
    return model


def re_estimated(model: dict, observed: list[tuple[list[int], list[tuple[int, ...]]]]) -> dict:
    """One round of Baum-Welch over pages of (words, features) by unit; a sure unit keeps its label.

    What a unit emits counts in proportion to its words, as in best_paths()."""
    k, n = len(STATES), 4
    start, move, emit = np.ones(k), np.ones((k, k)), np.ones((len(FEATURES), k, n))
    first, step = np.exp(model["start"]), np.exp(model["move"])
    each = np.arange(len(FEATURES))
    for words, rows in observed:
        f = np.array(rows, np.int64)
        weight = np.minimum(1, np.array(words, np.float64) / WEIGHTY)
        log = model["emit"][each, :, f].sum(1) * weight[:, None]
        e = np.exp(log - log.max(1, keepdims=True))
        for i, s in enumerate(map(sure_label, rows)):
            if s is not None:
                e[i] = np.arange(k) == s
        size = len(f)
        ahead, scale, back = np.empty((size, k)), np.empty(size), np.ones((size, k))
        for i in range(size):
            x = (first if i == 0 else ahead[i - 1] @ step) * e[i]
            scale[i] = x.sum()
            ahead[i] = x / scale[i]
        for i in range(size - 2, -1, -1):
            back[i] = step @ (e[i + 1] * back[i + 1]) / scale[i + 1]
        share = ahead * back
        share /= share.sum(1, keepdims=True)
        start += share[0]
        if size > 1:
            move += np.einsum("ti,ij,tj->ij", ahead[:-1], step, e[1:] * back[1:] / scale[1:, None])
        for j in range(len(FEATURES)):
            np.add.at(emit[j].T, f[:, j], share * weight[:, None])
    return _logs(start, move, emit)


def _logs(start, move, emit) -> dict:
    return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(1, keepdims=True)), "emit": np.log(emit / emit.sum(2, keepdims=True))}


def save(model: dict, path: Path = PARAMETERS) -> None:
    path.write_text(json.dumps({"states": STATES, "features": FEATURES} | {k: np.round(v, 3).tolist() for k, v in model.items()}) + "\n")


_LOADED: dict[str, dict] = {}


def load(path: str = str(PARAMETERS)) -> dict:
    if path not in _LOADED:
        raw = json.loads(Path(path).read_text())
        _LOADED[path] = {k: np.array(raw[k]) for k in ("start", "move", "emit")}
    return _LOADED[path]


def best_paths(pages: list[tuple[list[int], list[tuple[int, ...]]]], model: dict) -> list[np.ndarray]:
    """Viterbi's path through the states for every page, all pages a step at a time.

    A unit of few words tells little; what it emits counts less, in proportion to WEIGHTY words."""
    words = np.array(list(chain.from_iterable(sizes for sizes, _ in pages)), np.float64)
    pages = [rows for _, rows in pages]
    sizes = np.array([len(p) for p in pages], np.int64)
    flat = np.array(list(chain.from_iterable(pages)), np.int64).reshape(-1, len(FEATURES))
    emit = model["emit"][np.arange(len(FEATURES)), :, flat].sum(1) * np.minimum(1, words / WEIGHTY)[:, None]
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    score = np.full((len(pages), len(STATES)), -np.inf)
    some = int((length > 0).sum())
    score[:some] = model["start"] + emit[first[:some]]
    back = np.zeros((len(flat), len(STATES)), np.int8)
    for t in range(1, int(length[0]) if len(length) else 0):
        live = int((length > t).sum())
        step = score[:live, :, None] + model["move"]
        back[first[:live] + t] = step.argmax(1)
        score[:live] = step.max(1) + emit[first[:live] + t]
    path = np.zeros(len(flat), np.int64)
    state = score.argmax(1)
    for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
        live = int((length > t).sum())
        path[first[:live] + t] = state[:live]
        state[:live] = back[first[:live] + t, state[:live]]
    ends = np.cumsum(sizes)
    return [path[e - n : e] for e, n in zip(ends, sizes)]


def label(texts: list[str | None], model: dict) -> list[tuple[int, float]]:
    """(words, share of them in link lists, tag lists and menus) of pages; 0 words for null and blank texts."""
    seen = [features(units(t)) if t else ([], []) for t in texts]
    out = []
    for (sizes, _), path in zip(seen, best_paths(seen, model)):
        total = sum(sizes)
        out.append((total, sum(n for n, s in zip(sizes, path) if s in SPAM) / total if total else 0.0))
    return out


def shares(documents: DataFrame, parameters: str = str(PARAMETERS)) -> DataFrame:
    """(doc_id, words, spam_share) of every row; null and blank texts have 0 words and share 0."""
    rows = spread(documents.select("doc_id", "text"))

    def run(batches):
        model = load(parameters)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [x for i in range(0, len(texts), 1000) for x in label(texts[i : i + 1000], model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in done], pa.int32()), pa.array([s for _, s in done], pa.float64())], names=["doc_id", "words", "spam_share"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, words int, spam_share double")


def found(documents: DataFrame) -> DataFrame:
    """Problem 10's cases: doc_id of pages of at least 15 words, more than half of them not prose."""
    rows = shares(documents)
    return rows.where((rows.words >= LEAST_WORDS) & (rows.spam_share > SHARE)).select("doc_id").distinct()


def fit_on(documents: DataFrame) -> dict:
    """The model of a bounded sample: the texts of the smallest hashes of their ids."""
    rows = documents.where(F.col("text").isNotNull()).select("text", F.xxhash64("doc_id").alias("o")).orderBy("o").limit(SAMPLE)
    return fit([r.text for r in rows.collect()])

