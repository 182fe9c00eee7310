"""Personal data: fixed patterns, and what a linear-chain CRF adds to them.

The base patterns find well-formed emails, IP addresses, card and phone numbers. The field
looks at each word's shape and at the words around it, and also finds forms the patterns
pass over, such as a phone number without its plus sign. It is trained on the driver from a
small table of labelled lines and decoded by Viterbi, over all lines of an Arrow batch at
once, in numpy.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewgrain.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns. An email is looked for from its @, an IP address from the
# start of a run of digits: the same matches, without trying every place of a long word.
USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")

#: Labelled lines the training table holds at most, and passes over it.
MOST_LABELLED, EPOCHS = 600, 15
BATCH, RATE = 64, 0.3
#: Words kept on both sides of the data in a labelled line.
AROUND = 8
#: Longest piece of a line, in characters, that the training table is drawn from.
PIECE = 599
#: Chains decoded together, and words these may hold with their padding.
CHAINS_AT_ONCE, CHAIN_WORDS = 256, 1 << 17
#: Words and characters whose shapes a worker keeps.
WORDS_KEPT, CHARS_KEPT = 200_000, 1 << 24
#: Words scored at a time, so that a worker's arrays stay small.
WORDS_AT_ONCE = 1 << 15
SEED = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """The condition on a match of a kind's pattern."""
    digits = "".join(DIGIT.findall(found))
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in found.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of emails, leftmost and non-overlapping: the run of user characters before an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in USER:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every valid leftmost match of each kind, in order."""
    spans = [(start, 0, end) for start, end in emails(text)]
    for order, (kind, pattern) in enumerate((("ip", IP), ("card", CARD), ("phone", PHONE)), start=1):
        for found in pattern.finditer(text):
            if valid(kind, found[0]):
                spans.append((found.start(), order, found.end()))
    return [(start, end, KINDS[order]) for start, order, end in sorted(spans)]


# --- the conditional random field -----------------------------------------------------------

#: Labels: outside, and the first and further words of each kind.
LABELS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in ("B", "I")))
_FORBIDDEN = np.array(
    [[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS]
)


def shape(word: str) -> str:
    """A word's shape: runs of capitals, small letters and digits, and its other characters.

    Runs of digits keep their length up to 17; letters are as many as one or several; marks at
    the end of a sentence are left off.
    """
    word = word.strip(".,;:!?\"'")
    out: list[str] = []
    at = 0
    while at < len(word):
        c = word[at]
        kind = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        end = at + 1
        while end < len(word) and kind in "dXx" and _same(kind, word[end]):
            end += 1
        n = end - at
        out.append(f"d{min(n, 17)}" if kind == "d" else kind + ("+" if n > 1 and kind in "Xx" else ""))
        at = end
    return "".join(out)


def _same(kind: str, c: str) -> bool:
    return ("0" <= c <= "9") if kind == "d" else c.isupper() if kind == "X" else c.isalpha() and not c.isupper()


def features(word_shape: str) -> list[str]:
    """What is known of a word by its shape: the shape, and coarser views of it."""
    digits = sum(int(n) for n in re.findall(r"d(\d+)", word_shape))
    marks = "".join(sorted(set(re.sub(r"[dXx+0-9]", "", word_shape))))
    return [f"s={word_shape}", f"n={min(digits, 20)}", f"m={marks}", f"n={min(digits, 20)} m={marks}"]


@dataclass
class Field:
    """Weights of a trained field: per (position, feature) and label, and between labels."""

    index: dict[tuple[int, str], int]
    weights: np.ndarray
    moves: np.ndarray

    def scores_of(self, word_shape: str) -> np.ndarray:
        """For words of this shape: what they say of the next, of their own, of the last label."""
        out = np.zeros((3, len(LABELS)), dtype=np.float64)
        for near in (-1, 0, 1):
            for f in features(word_shape):
                at = self.index.get((near, f))
                if at is not None:
                    out[near + 1] += self.weights[at]
        return out


def _moves_allowed(moves: np.ndarray) -> np.ndarray:
    return np.where(_FORBIDDEN, -1e9, moves)


_START_FORBIDDEN = np.array([-1e9 if label.startswith("I-") else 0.0 for label in LABELS])


def _tensors(
    lines: list[tuple[list[str], list[int]]], index: dict[tuple[int, str], int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (line, word, feature), labels (line, word) and lengths; 0 is no feature."""
    per_word = 3 * len(features(""))
    longest = max(len(words) for words, _ in lines)
    at = np.zeros((len(lines), longest, per_word), dtype=np.int64)
    labels = np.zeros((len(lines), longest), dtype=np.int64)
    for i, (words, own) in enumerate(lines):
        shapes = [features(shape(w)) for w in words]
        labels[i, : len(words)] = own
        for t in range(len(words)):
            found = [
                index.setdefault((near, f), len(index) + 1)
                for near in (-1, 0, 1)  # -1: said by the next word; 1: by the one before
                if 0 <= t - near < len(words)
                for f in shapes[t - near]
            ]
            at[i, t, : len(found)] = found
    return at, labels, np.array([len(words) for words, _ in lines])


def train(lines: list[tuple[list[str], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Fit a field to lines of (words, labels): likelihood, L2 penalty, AdaGrad in fixed order.

    Without a labelled line the field finds nothing.
    """
    k = len(LABELS)
    index: dict[tuple[int, str], int] = {}
    lines = [(words, labels) for words, labels in lines if words]
    if not lines:
        return Field(index, np.zeros((1, k)), np.zeros((k, k)))
    at, labels, lengths = _tensors(lines, index)
    weights, moves = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    gw, gm = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffled = order.permutation(len(lines))
        for first in range(0, len(lines), BATCH):
            part = shuffled[first : first + BATCH]
            longest = int(lengths[part].max())
            own = at[part, :longest]
            d_emit, d_moves = _gradient(
                weights[own].sum(2), _moves_allowed(moves), labels[part, :longest], lengths[part]
            )
            used, where = np.unique(own, return_inverse=True)
            step = np.zeros((len(used), k))
            np.add.at(step, where.ravel(), np.repeat(d_emit.reshape(-1, k), own.shape[2], axis=0))
            step += 1e-3 * weights[used]
            step[used == 0] = 0.0
            gw[used] += step**2
            weights[used] -= RATE * step / np.sqrt(gw[used])
            d_moves += 1e-3 * moves
            gm += d_moves**2
            moves -= RATE * d_moves / np.sqrt(gm)
    return Field(index, weights, moves)


def _gradient(
    emit: np.ndarray, moves: np.ndarray, labels: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of some lines, by the forward and backward passes."""
    n, longest, k = emit.shape
    emit = emit.copy()
    emit[:, 0] += _START_FORBIDDEN
    forward, backward = np.empty_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    inside = np.arange(longest) < lengths[:, None]
    for t in range(1, longest):
        new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(inside[:, t + 1, None], new, 0.0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    d_emit = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
    rows, words = np.nonzero(inside)
    d_emit[rows, words, labels[rows, words]] -= 1
    d_moves = np.zeros((k, k))
    for t in range(1, longest):
        here = inside[:, t]
        after = (emit[:, t] + backward[:, t] - total[:, None])[here, None, :]
        d_moves += np.exp(forward[here, t - 1, :, None] + moves + after).sum(0)
        np.subtract.at(d_moves, (labels[here, t - 1], labels[here, t]), 1)
    return d_emit, d_moves


def viterbi(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of many chains at once: ``emit`` is (chains, longest, labels)."""
    chains, longest, k = emit.shape
    score = emit[:, 0] + _START_FORBIDDEN
    back = np.zeros((longest, chains, k), dtype=np.int8)
    for t in range(1, longest):
        step = score[:, :, None] + moves
        back[t] = step.argmax(1)
        new = step.max(1) + emit[:, t]
        score = np.where((t < lengths)[:, None], new, score)
    labels = np.zeros((chains, longest), dtype=np.int8)
    last = score.argmax(1)
    for t in range(longest - 1, -1, -1):
        ends = lengths - 1 == t
        labels[:, t] = np.where(ends, last, labels[:, t])
        if t:
            inside = t < lengths
            prev = back[t, np.arange(chains), labels[:, t]]
            labels[:, t - 1] = np.where(inside, prev, labels[:, t - 1])
    return labels


class Decoder:
    """Labels for the words of many texts, with the scores of each shape kept."""

    def __init__(self, model: Field):
        self.model, self.moves = model, _moves_allowed(model.moves)
        self.shapes: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((0, 3, len(LABELS)))

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.words) > WORDS_KEPT or self.chars > CHARS_KEPT:
            self.shapes, self.words, self.chars, self.table = {}, {}, 0, self.table[:0]
        known = self.words
        new = [w for w in set(words) if w not in known]
        rows = []
        for w in new:
            s = shape(w)
            if s not in self.shapes:
                self.shapes[s] = len(self.shapes)
                rows.append(self.model.scores_of(s))
            known[w] = self.shapes[s]
            self.chars += len(w)
        if rows:
            self.table = np.concatenate([self.table, np.array(rows)])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def labels(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Labels of each line's words."""
        out: list[np.ndarray] = []
        part: list[list[str]] = []
        held = 0
        for words in lines:
            part.append(words)
            held += len(words)
            if held >= WORDS_AT_ONCE:
                out += self._labels(part)
                part, held = [], 0
        return out + self._labels(part)

    def _labels(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The same for some lines: the parts that may hold data are decoded, like lengths together.

        A path that leaves O for a run of words scores against the one that stays there: what
        these words gain, and at most two moves each. A word that is in no run whose gains add
        up to nothing or more is O on the best path, so a chain is cut there without a change:
        each part is decoded between two words held at O.
        """
        sizes = np.array([len(words) for words in lines], dtype=np.int64)
        out = [np.zeros(n, dtype=np.int8) for n in sizes]
        flat = self.ids([w for words in lines for w in words])
        if not len(flat):
            return out
        starts = np.cumsum(sizes) - sizes
        score = self.table[flat]
        emit = score[:, 1].copy()
        joint = np.ones(len(flat) - 1, dtype=bool)  # whether a word and the next share a line
        inner = starts[(starts > 0) & (starts < len(flat))]
        joint[inner - 1] = False
        emit[:-1] += score[1:, 0] * joint[:, None]
        emit[1:] += score[:-1, 2] * joint[:, None]
        allowed = self.moves[self.moves > -1e8]
        gain = (emit[:, 1:] - emit[:, :1]).max(1) + 2 * max(allowed.max() - self.moves[0, 0], 0.0)
        line_of = np.repeat(np.arange(len(lines)), sizes)
        may = np.flatnonzero(_in_a_run(gain, starts[sizes > 0], line_of))
        if not len(may):
            return out
        new = np.flatnonzero((np.diff(may) > 1) | (np.diff(line_of[may]) > 0)) + 1
        firsts, lasts = may[np.r_[0, new]], may[np.r_[new - 1, len(may) - 1]] + 1
        for part in _batches(lasts - firsts):
            before = (firsts[part] > starts[line_of[firsts[part]]]).astype(np.int64)  # a word held at O goes ahead
            lengths = lasts[part] - firsts[part] + before + 1
            chains = np.zeros((len(part), int(lengths.max()), len(LABELS)))
            for row, (i, ahead) in enumerate(zip(part, before)):
                chains[row, ahead : lengths[row] - 1] = emit[firsts[i] : lasts[i]]
                if ahead:
                    chains[row, 0, 1:] = HELD
                chains[row, lengths[row] - 1, 1:] = HELD
                if lasts[i] == starts[line_of[firsts[i]]] + sizes[line_of[firsts[i]]]:
                    lengths[row] -= 1  # the line ends here
            best = viterbi(chains, lengths, self.moves)
            for row, (i, ahead) in enumerate(zip(part, before)):
                line = line_of[firsts[i]]
                n = lasts[i] - firsts[i]
                out[line][firsts[i] - starts[line] : lasts[i] - starts[line]] = best[row, ahead : ahead + n]
        return out


#: The score of a label that a word held at O must not take.
HELD = -1e9


def _in_a_run(gain: np.ndarray, starts: np.ndarray, line_of: np.ndarray) -> np.ndarray:
    """Whether each word is in a run of words of its line whose gains add up to nothing or more.

    The best sum that ends at a word and the best that starts there, by prefix sums less their
    least so far. Lines are walked one by one only where a word of theirs gains anything.
    """
    may = np.zeros(len(gain), dtype=bool)
    ends = np.append(starts[1:], len(gain))
    place = np.searchsorted(starts, np.flatnonzero(gain >= 0), side="right") - 1
    for i in np.unique(place):
        own = gain[starts[i] : ends[i]]
        sums = np.concatenate([np.zeros(1), np.cumsum(own)])
        ending = sums[1:] - np.minimum.accumulate(sums[:-1])
        starting = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
        may[starts[i] : ends[i]] = ending + starting - own >= -1e-6
    return may


def _batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Chains by length, few enough at a time for ``CHAIN_WORDS``, however long one is."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < CHAINS_AT_ONCE and (stop + 1 - at) * (lengths[order[stop]] + 2) <= CHAIN_WORDS:
            stop += 1
        yield order[at:stop]
        at = stop


def _runs(labels: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(first word, past the last, kind) of each labelled run."""
    at = 0
    for at in np.flatnonzero(labels % 2 == 1):
        end = at + 1
        while end < len(labels) and labels[end] == labels[at] + 1:
            end += 1
        yield int(at), int(end), KINDS[int(labels[at]) // 2]


#: What a span the field adds has to satisfy: its digits are those of a real number of its
#: kind, and it is not a well-formed match the base pattern itself refused.
_EDGES = " \t.,;:!?\"'()[]<>"


def _added(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    while start < end and text[start] in _EDGES and text[start] != "(":
        start += 1
    while end > start and text[end - 1] in _EDGES and text[end - 1] != ")":
        end -= 1
    found = text[start:end]
    digits = "".join(DIGIT.findall(found))
    fits = {
        "email": "@" in found[1:-1],
        "ip": bool(re.fullmatch(r"\D*(?:\d{1,3}\D{1,3}){3}\d{1,3}\D*", found)) and all(int(p) <= 255 for p in re.findall(r"\d+", found)),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15 and len(re.findall(r"\d+", found)) >= 3,
    }[kind]
    return (start, end, kind) if fits else None


class _Taken:
    """Whether a span meets a base span, by the furthest end of those that begin before it."""

    def __init__(self, base: list[tuple[int, int, str]]):
        self.starts = [start for start, _, _ in base]
        self.ends = list(accumulate((end for _, end, _ in base), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def all_spans(texts: list[str], decoder: Decoder) -> list[tuple[list, list]]:
    """For each text its base spans and its added ones, over whole texts, line by line."""
    where, lines = [], []
    for t, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            where.append((t, at))
            lines.append(WORD.findall(line))
            at += len(line) + 1
    found = [(base_spans(text), []) for text in texts]
    taken: dict[int, _Taken] = {}
    for (t, at), words, labels in zip(where, lines, decoder.labels(lines)):
        if not labels.any():
            continue
        base, added = found[t]
        if t not in taken:
            taken[t] = _Taken(base)
        line_end = texts[t].find("\n", at)
        line = texts[t][at : line_end if line_end >= 0 else None]
        places = [(at + m.start(), at + m.end()) for m in WORD.finditer(line)]
        for a, b, kind in _runs(labels):
            span = _added(texts[t], places[a][0], places[b - 1][1], kind)
            # Runs come in order, so of the added spans only the last can reach into this one.
            if span and not taken[t].meets(span[0], span[1]) and not (added and added[-1][1] > span[0]):
                added.append(span)
    return found


# --- the labelled table and the operator ----------------------------------------------------


def label_words(line: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    words, labels, begun = [], [], set()
    for m in WORD.finditer(line):
        label = 0
        for span in spans:
            start, end, kind = span
            if m.start() < end and start < m.end():
                label = LABELS.index(("I-" if span in begun else "B-") + kind)
                begun.add(span)
        words.append(m[0])
        labels.append(label)
    return words, labels


def variants(line: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """The line as it is, and with its data in forms that the base patterns pass over."""
    yield line, spans
    if len(spans) != 1:
        return
    start, end, kind = spans[0]
    found = line[start:end]
    digits = "".join(DIGIT.findall(found))
    if kind == "phone" and len(digits) == 11:
        a, b, c = digits[1:4], digits[4:7], digits[7:]
        others = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[0]} {a} {b} {c}", f"{digits[0]} {a} {b} {c}"]
    elif kind == "card" and len(digits) == 16:
        g = [digits[i : i + 4] for i in range(0, 16, 4)]
        others = [".".join(g), "/".join(g), "-".join(g)]
    elif kind == "email":
        user, _, host = found.partition("@")
        others = [f"<{found}>", f"mailto:{found}", f"{user} @ {host}"]
    elif kind == "ip":
        others = [found.replace(".", ","), "[" + found.replace(".", "[.]") + "]"]
    else:
        return
    for other in others:
        yield line[:start] + other + line[end:], [(start, start + len(other), kind)]


_PIECE = rf"[^\n]{{1,{PIECE}}}(?=\n|\z)|[^\n]{{1,{PIECE}}}(?<=\p{{L}})(?=[ \t]\p{{L}})|[^\n]{{1,{PIECE}}}"


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> list[tuple[list[str], list[int]]]:
    """The training table, from the documents: at most ``most`` lines that hold digits or @.

    Lines of over ``PIECE`` characters are drawn in pieces, cut between two letters where they
    have such a place. Lines are drawn by hash, so the same documents always give the same table; the base
    patterns label them, and ``variants`` adds other forms. It is the one thing collected,
    and its size is this bound.
    """
    line = docs.select(F.explode(F.regexp_extract_all(text_of(text), F.lit(_PIECE), 0)).alias("line")).where(F.col("line").rlike("[0-9@]"))
    # Half of the table for lines that look like data, half for any with a digit.
    likely = F.col("line").rlike(r"@|\+[0-9]|[0-9]{12}|[0-9]\.[0-9]+\.[0-9]")
    drawn = F.xxhash64("line", F.lit(SEED))
    halves = [line.where(likely), line.where(~likely)]
    rows = [r[0] for h in halves for r in h.select("line", drawn.alias("drawn")).distinct().orderBy("drawn", "line").limit(most // 2).select("line").collect()]
    table = []
    for row in rows:
        for other, spans in variants(row, base_spans(row)):
            table += _windows(*label_words(other, spans))
    return table


def _windows(words: list[str], labels: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    """The parts of a line around its labelled words and its words with a digit."""
    near = [t for t, (w, label) in enumerate(zip(words, labels)) if label or DIGIT.search(w)]
    at = 0
    while near:
        start = max(near[0] - AROUND, at)
        at = near[0] + 1
        while near and near[0] <= at + AROUND:
            at = near.pop(0) + 1
        at = min(at + AROUND, len(words))
        yield words[start:at], labels[start:at]


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind in the order of ``KINDS``."""
    order = F.array(*[F.lit(k) for k in KINDS])
    placed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("order"), s.alias("span"))
    )
    written = lambda p: F.concat_ws(":", p["span"]["kind"], p["span"]["start"], p["span"]["end"])
    return F.array_join(F.transform(F.sort_array(placed), written), ",")


def personal_data(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end) in code points, end exclusive.

    ``base`` are the patterns' valid matches; ``added`` what the field finds besides, never
    over a base span. NULL and empty texts have none. Whole texts are read; a batch holds
    bounded bytes. Rows that repeat get a row each; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training table
    span = T.StructType.fromDDL("kind string, start int, `end` int")
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            found = all_spans(batch.column("text").to_pylist(), decoder)
            named = [[[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in pair] for pair in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([pair[i] for pair in named], kinds) for i in (0, 1))],
                ["doc_id", "base", "added"],
            )

    frame = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    schema = T.StructType([frame.schema["doc_id"], T.StructField("base", T.ArrayType(span)), T.StructField("added", T.ArrayType(span))])
    return frame.mapInArrow(run, schema)
