r"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by pattern, in time linear in the
text. The field adds what patterns miss: phone numbers without a plus, bracketed addresses, card numbers with
other separators, and secrets (tokens, keys, passwords). Its features are the shapes of a word and of its two
neighbours and a few cue words; it is trained from the labelled sentences of ``pii_rows`` by maximum likelihood
with L2 penalty, and decoded by Viterbi in numpy batches. An added span must not touch a base span and must pass an
exact check of its kind (digits of a phone number, Luhn, an address of two parts).

Labels have no begin mark, so neighbouring spans of one kind decode as one run of words. A run that fails its check is cut
into the pieces that hold and cover most of its words; where words are left over, bare numbers are no phone number.

The field only sees words with a digit or an @. Secrets that their surroundings or their form give away are therefore also
found by pattern (``named_secrets``), whatever the field says: values of six characters or more that follow a secret's
name and = or :, of letters only or digits only too, and access keys of the form AKIA or ASIA and 16 characters. A plain
word is no value of a bare ``key``, nor after a colon and a space of ``token``, ``secret`` and the keys, unless it is quoted. A
digit-free secret with neither a name and = or : before it nor that form is not found.

A word without a digit or an @ is O, in training and decoding. Such words cut the chain, so that the best path
of a whole text is made of the best paths of its runs of other words, each with its neighbours' shapes. Runs are
decoded in batches of like lengths, padded to the longest.

Defined results: null text is empty text, with no spans; offsets are code points, ends exclusive; repeated rows are
judged alike; texts and words of any length are read whole; other columns are kept, those named base and added are replaced by find;
redact changes nothing but the text, and a column of sizes if there is one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_rows import LABELLED

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("O", *KINDS)
MEMO = 1 << 19

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+")
_HEX = re.compile(r"[0-9a-fA-F]+")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]+")
#: A secret's name and its value in one word.
_ASSIGNED = re.compile(r"(?i:token|secret|password|passwd|pwd|pass|key|apikey|api_key|access_key)[=:][\"']?(\S{6,})")
_SIGNS = re.compile(r"[=:]|A[KS]IA")
_ACCESS_KEY = re.compile(r"(?<![^\W_])A[KS]IA[A-Z0-9]{16}(?![^\W_])")
#: A secret's name up to the sign after it. NAME_REACH characters hold the longest one.
_NAME = re.compile(r"(?i)(?<![^\W_])((?:api|access|secret|private)[_ -]?key|token|secret|password|passwd|pwd|pass|key)[\"']?\s{0,3}\Z")
NAME_REACH = 24
#: The most digits of a number that is looked for.
PIECE_WORDS = 19
_VALUE = re.compile(r"(\s{0,3})(?:\"([^\s\"]{6,})|'([^\s']{6,})|([^\s\"']\S{5,}))")
_PLACEHOLDER = re.compile(r"\s{0,3}[\"']?(?:<|\$?\{|%\()")
_PLAIN = re.compile(r"[^\W\d_]?[^\W\d_A-Z]+(?:['’-][^\W\d_A-Z]+)*")
_WORD = re.compile(r"\S+")
_OPEN = re.compile(r"[0-9@]")
_OUTER = "\"'`()[]{}<>.,;:!?*#%$&|~^"
#: Cue words whose identity is a feature.
CUES = frozenset("token secret password passwd key api apikey tel phone call fax mobile telefon mail email ip card = :".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind and start; a match that fails its check is dropped and not tried again."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def named_secrets(text: str) -> list[tuple[str, int, int]]:
    """Values after a secret's name, and access keys. Linear: each value is read once, names are looked for in a bounded reach."""
    out = []
    m = _SIGNS.search(text)
    while m:
        at, go = m.start(), m.end()
        if m.end() - at > 1:
            if key := _ACCESS_KEY.match(text, at):
                go = key.end()
                out.append(("secret", at, go))
        elif (name := _NAME.search(text[max(0, at - NAME_REACH) : at])) and not _PLACEHOLDER.match(text, go) and (value := _VALUE.match(text, go)):
            start, go = value.span(value.lastindex)
            said, what = value[value.lastindex], name[1].lower()
            if value.lastindex == 4:  # without quotes
                said = said.rstrip(_OUTER)
                doubtful = what == "key" or value[1] and text[at] == ":" and not what.startswith("pass") and what != "pwd"
                if doubtful and _PLAIN.fullmatch(said):
                    said = ""
            if len(said) >= 6:
                out.append(("secret", start, start + len(said)))
        m = _SIGNS.search(text, go)
    return out


def core(word: str) -> str:
    return word.strip(_OUTER)


def word_features(word: str) -> tuple[str, ...]:
    """Shape features of one word, as stripped of outer punctuation; words of letters only share a few types."""
    inner = core(word)
    low = inner.lower() if inner else word
    if low in CUES or word in CUES:
        return ("cue=" + (low if low in CUES else word),)
    if not inner:
        return ("punct",)
    if inner.isalpha():
        return ("alpha",)
    shape = _RUNS.sub(lambda m: f"9{min(len(m[0]), 20)}" if m[0][0].isdigit() else m[0][0].upper() if m[0][0].isupper() else "a", inner)
    loose = _RUNS.sub(lambda m: "9" if m[0][0].isdigit() else "a", inner)
    out = ["shape=" + shape[:40], "loose=" + loose[:40]]
    n = len(_DIGIT.findall(inner))
    out.append("no digit" if not n else f"digits={min(n, 20) // 3}")
    letters = any(c.isalpha() for c in inner)
    if len(inner) >= 16 and n and letters:
        if _HEX.fullmatch(inner):
            out.append("hex")
        if _KEY.fullmatch(inner):
            out.append("key")
        if inner.isupper():
            out.append("upper key")
    if word[:1] in "\"'" and len(inner) >= 8 and n and letters:
        out.append("quoted mix")
    if _ASSIGNED.fullmatch(inner):
        out.append("assigned")
    return tuple(out)


class Field:
    """Weights by feature, for a word's own, previous and next place; transitions between labels."""

    def __init__(self, weights: dict[tuple[int, str], np.ndarray], trans: np.ndarray):
        self.weights, self.trans = weights, trans


class Tables(dict):
    """features -> (3, labels): what a word of these features adds to the next word, to itself and to the word before."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, features: tuple[str, ...]) -> np.ndarray:
        if len(self) >= MEMO:
            self.clear()
        zero, w = np.zeros(len(LABELS)), self.field.weights
        made = self[features] = np.array([sum((w.get((place, f), zero) for f in features), zero) for place in (-1, 0, 1)])
        return made


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of a batch (sequence, step, label), each run between two words that are O."""
    n, steps, k = scores.shape
    best = trans[0] + scores[:, 0]
    back = np.zeros((n, steps, k), np.int8)
    for t in range(1, steps):
        all_ = best[:, :, None] + trans
        back[:, t] = all_.argmax(axis=1)
        now = all_.max(axis=1) + scores[:, t]
        best = np.where((t < lengths)[:, None], now, best)
    path = np.zeros((n, steps), np.int8)
    last = (best + trans[:, 0]).argmax(axis=1)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        path[inside, t] = last[inside]
        last = np.where(inside, back[rows, t, last], last)
    return path


def open_runs(text: str) -> list[tuple[list[tuple[int, int]], str, str]]:
    """Runs of neighbouring words with a digit or an @: their places, the word before and the word after."""
    runs: list[tuple[list[tuple[int, int]], str, str]] = []
    m, last = _OPEN.search(text), 0
    while m:
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        end = _WORD.match(text, start).end()
        if runs and text[runs[-1][0][-1][1] : start].isspace():
            runs[-1][0].append((start, end))
        else:
            runs.append(([(start, end)], "", ""))
        last = end
        m = _OPEN.search(text, end)
    return [(at, _word_before(text, at[0][0]), (w := _WORD.search(text, at[-1][1])) and w[0] or "") for at, _, _ in runs]


def _word_before(text: str, end: int) -> str:
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:end]


def decode(texts: list[str], tables: Tables, split: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text: runs of words of one label, without outer punctuation. split: runs that fail their check are cut."""
    runs = [(i, at, before, after) for i, text in enumerate(texts) for at, before, after in open_runs(text)]
    runs.sort(key=lambda r: len(r[1]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    done = 0
    while done < len(runs):  # a batch holds few runs where they are long
        size = 512
        while size > 1 and size * len(runs[min(done + size, len(runs)) - 1][1]) > 1 << 17:
            size //= 2
        part = runs[done : done + size]
        done += size
        lengths = np.array([len(r[1]) for r in part])
        scores = np.zeros((len(part), lengths.max(), len(LABELS)))
        for row, (i, at, before, after) in enumerate(part):
            own = np.array([tables[word_features(texts[i][a:b])] for a, b in at])
            n = len(at)
            scores[row, :n] = own[:, 1]
            scores[row, 1:n] += own[:-1, 0]
            scores[row, : n - 1] += own[1:, 2]
            if before:
                scores[row, 0] += tables[word_features(before)][0]
            if after:
                scores[row, n - 1] += tables[word_features(after)][2]
        path = viterbi(scores, lengths, tables.field.trans)
        for row in np.flatnonzero(path.any(axis=1)).tolist():
            i, at, _, _ = part[row]
            t = 0
            while t < len(at):
                label, first = int(path[row, t]), t
                while t < len(at) and path[row, t] == label:
                    t += 1
                if label:
                    whole = _piece(LABELS[label], texts[i], at[first][0], at[t - 1][1])
                    out[i] += [whole] if whole else _cut(LABELS[label], texts[i], at[first:t]) if split and t - first > 1 else []
    return [sorted(spans, key=lambda s: s[1:]) for spans in out]


def _piece(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    span = _trimmed(text, start, end)
    if span and kind == "secret" and (m := _ASSIGNED.fullmatch(text, *span)):
        span = m.span(1)
    return (kind, *span) if span and _holds(kind, text[span[0] : span[1]]) else None


def _cut(kind: str, text: str, at: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of all ways to cut words into pieces that hold, one that covers most words. No number has more words than PIECE_WORDS digits."""
    best: list[tuple[int, int, tuple | None]] = [(0, 0, None)]  # words covered up to here, where the last piece begins, the piece
    for n in range(1, len(at) + 1):
        now = (best[n - 1][0], n - 1, None)
        for k in range(n - 1, max(-1, n - 1 - PIECE_WORDS), -1):
            if best[k][0] + n - k > now[0] and (piece := _piece(kind, text, at[k][0], at[n - 1][1])):
                now = (best[k][0] + n - k, k, piece)
        best.append(now)
    out, n = [], len(at)
    while n:
        _, n, piece = best[n]
        if piece:
            out.append(piece)
    if kind == "phone" and best[-1][0] < len(at):  # years in a row are digits enough
        out = [s for s in out if any(c in "+(-." for c in text[s[1] : s[2]])]
    return out[::-1]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    while start < end and text[start] in _OUTER and text[start] != "(":
        start += 1
    while end > start and text[end - 1] in _OUTER:
        end -= 1
    return (start, end) if end > start else None


_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+[\[({]?@[\])}]?[A-Za-z0-9-]+(?:(?:\.|[\[({](?:dot|DOT|\.)[\])}])[A-Za-z0-9-]+)+")


#: What a phone number is written with; dates and spans of years that may stand beside other numbers; and how one begins that has no sign in it.
_NUMBER = re.compile(r"[0-9+() ./_\t\n-]+")
_DATE = re.compile(r"(?<![0-9])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:1[0-9]|20)[0-9]{2}|(?:1[0-9]|20)[0-9]{2}-(?:[0-9]{2}-[0-9]{2}|(?:1[0-9]|20)[0-9]{2}))(?![0-9])")
_BEGINS = re.compile(r"0[0-9]")


def _holds(kind: str, span: str) -> bool:
    """The exact check of an added span."""
    d = _digits(span)
    if kind == "phone":
        return 9 <= len(d) <= 15 and bool(_NUMBER.fullmatch(span)) and not _DATE.search(span) and (any(c in "+(-./" for c in span) or bool(_BEGINS.match(span)))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not any(c.isalpha() for c in span)
    if kind == "ip":
        return all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in span.split(".")) and span.count(".") == 3
    if kind == "email":
        return bool(_SPELLED.fullmatch(span))
    return len(span) >= 8 and bool(d) and any(c.isalpha() for c in span) and not any(c.isspace() for c in span)


def all_spans(texts: list[str], tables: Tables) -> list[tuple[list, list]]:
    """(base, added) of each text."""
    out = []
    for text, more in zip(texts, decode(texts, tables, split=True)):
        base = base_spans(text)
        free = [s for s in more + named_secrets(text) if not any(s[1] < e and b < s[2] for _, b, e in base)]
        out.append((base, _joined(free)))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in order; those that overlap as one, of the kind of the longest that begins first."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], b))
        else:
            out.append((kind, a, b))
    return out


def labelled_rows() -> list[tuple[list[str], list[int]]]:
    """Sentences of pii_rows as words and label numbers. ``[kind words]`` marks a span."""
    out = []
    for line in LABELLED:
        words, labels, now = [], [], 0
        for word in line.split():
            if word.startswith("[") and word[1:] in KINDS:
                now = LABELS.index(word[1:])
                continue
            ends = word.endswith("]") and now
            words.append(word[:-1] if ends else word)
            labels.append(now)
            if ends:
                now = 0
        out.append((words, labels))
    return out


def fit(rows: list[tuple[list[str], list[int]]] | None = None, steps: int = 300, penalty: float = 0.02, rate: float = 0.1) -> Field:
    """Maximum conditional likelihood by Adam on all sentences at once. Deterministic."""
    rows = rows or labelled_rows()
    feats = [[word_features(w) for w in words] for words, _ in rows]
    names: dict[tuple[int, str], int] = {}
    n, steps_t, k = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    at = []
    for i, fs in enumerate(feats):
        for t, f in enumerate(fs):
            for place in (-1, 0, 1):
                s = t - place  # a word's features with place -1 act on the word after it
                if 0 <= s < len(fs):
                    at += [(i, s, names.setdefault((place, x), len(names))) for x in f]
    x = np.zeros((n, steps_t, len(names)))
    for i, t, f in at:
        x[i, t, f] = 1
    y = np.zeros((n, steps_t), int)
    lengths = np.array([len(w) for w, _ in rows])
    for i, (_, labels) in enumerate(rows):
        y[i, : len(labels)] = labels
    mask = np.arange(steps_t)[None] < lengths[:, None]
    closed = np.array([[t >= len(words) or not _OPEN.search(words[t]) for t in range(steps_t)] for words, _ in rows])
    only_o = np.where(closed[:, :, None] & (np.arange(k) > 0), -50.0, 0.0)
    w, tr = np.zeros((len(names), k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    want_w = np.einsum("itf,itk->fk", x * mask[:, :, None], np.eye(k)[y])
    want_t = np.zeros((k, k))
    for i, (_, labels) in enumerate(rows):
        for a, b in zip([0, *labels], [*labels, 0]):
            want_t[a, b] += 1
    for step in range(1, steps + 1):
        s = x @ w + only_o
        fwd, bwd = np.zeros((n, steps_t, k)), np.zeros((n, steps_t, k))
        fwd[:, 0] = tr[0] + s[:, 0]
        for t in range(1, steps_t):
            fwd[:, t] = np.where(mask[:, t, None], lse(fwd[:, t - 1, :, None] + tr, 1) + s[:, t], fwd[:, t - 1])
        bwd[:, -1] = tr[:, 0]
        for t in range(steps_t - 2, -1, -1):
            bwd[:, t] = np.where(mask[:, t + 1, None], lse(tr[None] + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), tr[:, 0])
        z = lse(fwd[:, -1] + tr[:, 0], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        got_t = np.zeros((k, k))
        pair = np.exp(fwd[:, :-1, :, None] + tr + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        got_t += (pair * mask[:, 1:, None, None]).sum(axis=(0, 1))
        got_t[0] += p[:, 0].sum(axis=0)
        got_t[:, 0] += p[np.arange(n), lengths - 1].sum(axis=0)
        grads = [(want_w - np.einsum("itf,itk->fk", x, p)) / n - penalty * w / 10, (want_t - got_t) / n - penalty * tr / 10]
        for g, v, m in ((grads[0], w, 0), (grads[1], tr, 2)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[m + 1] = 0.99 * moments[m + 1] + 0.01 * g * g
            v += rate * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[m + 1] / (1 - 0.99**step)) + 1e-8)
    return Field({name: w[f] for name, f in names.items()}, tr)


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, and the spans: base and added (in place of columns of these names)."""
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("base", "added")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", base {_SPANS}, added {_SPANS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(field)
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            got = all_spans([t or "" for t in batch.column(text_col).to_pylist()], tables)
            made = [pa.array([as_rows(g[i]) for g in got], _ARROW) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, "base", "added"])

    return docs.mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    told = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(n, BASE_KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, field: Field, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with each span (spans that overlap as one) replaced by ``[KIND]``; size_col follows where a text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(field)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            got = all_spans([t or "" for t in texts], tables)
            sizes = batch.column(size_col).to_pylist() if size_col in batch.schema.names else [None] * len(texts)
            for i, (base, added) in enumerate(got):
                if base or added:
                    merged: list[list] = []
                    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                        if merged and a < merged[-1][2]:
                            merged[-1][2] = max(merged[-1][2], b)
                        else:
                            merged.append([kind, a, b])
                    out, last = [], 0
                    for kind, a, b in merged:
                        out += [texts[i][last:a], f"[{kind.upper()}]"]
                        last = b
                    texts[i] = "".join(out) + texts[i][last:]
                    sizes[i] = len(texts[i])
            told = [pa.array(texts, f.type) if f.name == text_col else pa.array(sizes, f.type) if f.name == size_col else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(told, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
