"""Language of whole texts, and of the spans of mixed ones.

A word's bytes tell its script; the script narrows the languages to those that were seen to use it. Each language scores
a word by naive Bayes over the word itself, its first and its last letters (hashed counts of a bounded sample of labelled
texts). A Viterbi pass over a text's words, with a penalty for each switch of language, labels spans. The text's language
is the one with most letters; its score is that language's share of them.

Long texts are cut into stretches of STRETCH words for the pass: for each stretch the best path from each first to each
last language is found, all stretches of a batch in step, then the stretches of each text are joined by a second Viterbi
pass over them. The result is that of one pass over the whole text.

A null text, or one without any letter, is "und" with a score of 0. A text with letters but no learned language (an
empty sample) is "und" too. Languages with as many letters: the first by name. Rows that repeat a doc_id are judged each;
an empty table gives an empty one. Other columns are kept, but those that bear the name of an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ._common import slices, text_batches, text_bytes, without
from ._sample import labelled_sample
from ._words import _BASES, _BYTES, ALNUM, LOWER, Words, _ranges, _sums, mix, words

STRETCH = 128
#: Script by the first byte of a word in UTF-8. Ranges of Unicode's blocks by lead byte.
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "asian", "hangul", "other")
_RANGES = [(0x00, 0xCC, 0), (0xCC, 0xD0, 1), (0xD0, 0xD5, 2), (0xD5, 0xD8, 3), (0xD8, 0xE0, 4), (0xE0, 0xE1, 5), (0xE1, 0xE3, 8), (0xE3, 0xEA, 6), (0xEA, 0xEE, 7), (0xEE, 0x100, 8)]
_SCRIPT = np.zeros(256, np.int64)
for _a, _b, _s in _RANGES:
    _SCRIPT[_a:_b] = _s
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: First bytes of characters that weigh in a vote: not those whose characters are mostly quotes, dashes, signs and emoji.
_VOTES = _LETTER.copy()
_VOTES[[b for b in range(0xC3, 0xF0) if b != 0xE2]] = True


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  #: (buckets, languages), logarithms of probabilities
    allowed: np.ndarray  #: (scripts, languages), 0 or a large penalty
    switch: float

    def word_scores(self, raw: np.ndarray, w: Words) -> np.ndarray:
        f = features(raw, w, len(self.logs))
        s = self.logs[f[0]].copy()
        for row in f[1:]:
            s += self.logs[row]
        return s + self.allowed[_SCRIPT[raw[w.start]]]


def features(raw: np.ndarray, w: Words, buckets: int) -> np.ndarray:
    """Buckets of each word: itself, its first 2 and 3 bytes, its last 2 and 3."""
    sums = _sums(_BYTES[LOWER[raw]], _BASES[0])
    out = [w.hash]
    for n in (2, 3):
        out.append(mix(_ranges(sums, w.start, np.minimum(w.end, w.start + n), _BASES[0])) + np.uint64(2 * n))
        out.append(mix(_ranges(sums, np.maximum(w.start, w.end - n), w.end, _BASES[0])) + np.uint64(2 * n + 1))
    return np.stack([(h & np.uint64(buckets - 1)).astype(np.int32) for h in out])


def fit(sample: list[tuple[str, str]], buckets: int = 1 << 16, switch: float = 12.0) -> Languages:
    names = sorted({v for _, v in sample})
    logs, allowed = np.zeros((buckets, max(1, len(names))), np.float32), np.zeros((len(SCRIPTS), max(1, len(names))), np.float32)
    for k, name in enumerate(names):
        texts = [t for t, v in sample if v == name]
        counts, scripts = np.full(buckets, 0.5), np.zeros(len(SCRIPTS))
        for begin in range(0, len(texts), 250):
            raw, offsets = text_bytes(pa.array(texts[begin : begin + 250], pa.large_string()))
            w = words(raw, offsets, ALNUM, True)
            counts += np.bincount(features(raw, w, buckets).ravel(), minlength=buckets)
            scripts += np.bincount(_SCRIPT[raw[w.start]], minlength=len(SCRIPTS))
        logs[:, k] = np.log(counts / counts.sum())
        share = scripts / max(1, scripts.sum())
        allowed[:, k] = np.where(share < 0.01, -1e4, 0)
    allowed[(allowed < 0).all(1)] = 0  # a script that no language is known for narrows nothing
    return Languages(names, logs - logs.max(1, keepdims=True), allowed, switch)


def best_paths(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word: the path of the highest sum of scores, less `switch` for each change, text by text."""
    n, k = scores.shape
    path = np.zeros(n, np.int64)
    if not n or k == 1:
        return path
    count = np.diff(first)
    pieces = -(-count // STRETCH)
    base = np.repeat(first[:-1], pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(base + STRETCH, np.repeat(first[1:], pieces)) - base
    steps = int(size.max())
    at = np.minimum(base[:, None] + np.arange(steps), n - 1)
    each = np.where((np.arange(steps) < size[:, None])[..., None], scores[at], 0).astype(np.float64)
    best = np.full((len(base), k, k), -1e18)  # [stretch, first language, last language]
    best[:, np.arange(k), np.arange(k)] = each[:, 0]
    came = np.zeros((steps, len(base), k, k), np.uint8)
    stay = np.arange(k, dtype=np.uint8)
    for t in range(1, steps):
        top = best.argmax(-1)
        other = np.take_along_axis(best, top[..., None], -1) - switch
        moved = other > best
        came[t] = np.where(moved, top[..., None].astype(np.uint8), stay)
        best = np.where(moved, other, best) + each[:, t, None, :]
    # join the stretches of each text
    texts = np.flatnonzero(pieces)
    begin = (np.cumsum(pieces) - pieces)[texts]
    m = pieces[texts]
    change = switch * (1 - np.eye(k))
    total = best[begin].max(1)  # by last language
    entry = np.zeros((len(base), k), np.int64)  # the best first language of a stretch for each last one
    before = np.zeros((len(base), k), np.int64)  # and the last language of the stretch before it, for each first one
    entry[begin] = best[begin].argmax(1)
    for j in range(1, int(m.max())):
        live = np.flatnonzero(m > j)
        b = begin[live] + j
        into = total[live][:, :, None] - change
        before[b] = into.argmax(1)
        joined = into.max(1)[:, :, None] + best[b]
        entry[b] = joined.argmax(1)
        total[live] = joined.max(1)
    last = np.zeros(len(base), np.int64)
    now = total.argmax(1)
    for j in range(int(m.max()) - 1, -1, -1):
        live = np.flatnonzero(m > j)
        b = begin[live] + j
        last[b] = now[live]
        if j:
            now[live] = before[b, entry[b, last[b]]]
    # and walk back inside all stretches at once; padding never changes the language
    rows, enter = np.arange(len(base)), entry[np.arange(len(base)), last]
    state = last
    for t in range(steps - 1, -1, -1):
        inside = t < size
        path[base[inside] + t] = state[inside]
        state = came[t, rows, enter, state].astype(np.int64) if t else state
    return path


def identify(docs: DataFrame, model: Languages, spans: bool = False) -> DataFrame:
    """docs with lang_pred and score, and with spans: (start, end, lang) in characters."""
    docs = without(docs, ["lang_pred", "score", *["spans"] * spans])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the fixed size `buckets` times the languages
    names = docs.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        model = shared.value
        k = max(1, len(model.names))
        for b in slices(batches, most=max(50_000, 64_000_000 // k**2)):  # the pass holds k * k states for each word
            raw, offsets = text_bytes(b.column("text"))
            w = words(raw, offsets, ALNUM, True)
            path = best_paths(model.word_scores(raw, w), w.first, model.switch)
            letters = np.concatenate([[0], np.cumsum(_VOTES[raw])])
            weight = letters[w.end] - letters[w.start]
            text = w.text_of()
            held = np.bincount(text * k + path, weight, b.num_rows * k).reshape(-1, k) if len(path) else np.zeros((b.num_rows, k))
            total, top = held.sum(1), held.argmax(1)
            ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
            known = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            beyond = np.concatenate([[0], np.cumsum(raw >= 0xC0)])
            for i in np.flatnonzero(~known & (beyond[offsets[1:]] > beyond[offsets[:-1]])):
                known[i] = any(c.isalpha() for c in b.column("text")[int(i)].as_py() or "")
            known &= len(model.names) > 0
            lang = [model.names[t] if ok else "und" for t, ok in zip(top, known, strict=True)]
            out = [*b.columns, pa.array(lang), pa.array(np.where(known, held[np.arange(len(top)), top] / np.maximum(total, 1), 0.0))]
            if spans:
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])])) if len(path) else np.zeros(0, int)
                found: list[list] = [[] for _ in range(b.num_rows)]
                for a, z in zip(new, [*(new[1:] - 1), len(path) - 1], strict=False):
                    d = text[a]
                    found[d].append({"start": int(chars[w.start[a]] - chars[offsets[d]]), "end": int(chars[w.end[z]] - chars[offsets[d]]), "lang": model.names[path[a]]})
                out.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "lang_pred", "score", *["spans"] * spans])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return text_batches(docs).mapInArrow(run, schema + ", spans array<struct<start:bigint,end:bigint,lang:string>>" * spans)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = 4000, most_bytes: int = 16_384, switch: float = 12.0) -> Languages:
    """From labels.lang of at most `sample` rows that `allowed` (over doc_id) lets in."""
    return fit(labelled_sample(docs, labels, "lang", allowed, sample, most_bytes), switch=switch)
