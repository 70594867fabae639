"""Personal data by base patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: those of the patterns, and forms that the patterns don't know, written
from them (other separators, spaces, brackets about @ and dots, no plus). It reads overlapping windows around every digit and @
of the whole text (all kinds hold one). Where windows overlap, their scores are averaged, those from the middle of a window
counting most, and one best path under the transitions is decoded over each stretch of the text that windows cover. Its
spans join those of the patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Kinds, in the order of ties.
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
HIDDEN, WINDOW, STEP = 16, 64, 32
#: Labelled windows that training takes at most, steps and sequences of a step.
TRAIN_WINDOWS, STEPS, BATCH = 1500, 240, 48

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and non-overlapping within a kind; failing ones are dropped."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at  # the run of local characters before @, linear in its length
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := _AT.match(text, at)):
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _classes() -> np.ndarray:
    table = np.full(129, 16, np.int64)
    table[128] = 17
    for chars, number in (("0123456789", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (" ", 4), ("\t\n\r\v\f", 5), ("@", 6), (".", 7), ("-", 8), ("+", 9), ("(", 10), (")", 11), ("_%", 12), (",", 13), (":;", 14), ("\"'", 15)):
        for c in chars:
            table[ord(c)] = number
    return table


CLASSES = 18
_CLASS = _classes()


def char_classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)]


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for start, end, kind in spans:
        if not out[start:end].any():  # the first of overlapping spans
            out[start:end] = 2 + 2 * KINDS.index(kind)
            out[start] -= 1
    return out


def window_starts(triggers: np.ndarray, n: int) -> np.ndarray:
    """Starts of overlapping windows, on a grid of STEP, that cover STEP characters about every trigger."""
    cells = np.unique(np.concatenate([triggers // STEP + k for k in (-2, -1, 0)])) * STEP
    return np.unique(np.clip(cells, 0, max(n - WINDOW, 0)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights of both directions, of the output and of the tag transitions; about 20 kilobytes."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, g = HIDDEN, 4 * HIDDEN
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 0.3, (CLASSES, g))
            self.w[f"h{side}"] = rng.normal(0, 0.2, (h, g))
        self.w |= {"o": rng.normal(0, 0.2, (2 * h, TAGS)), "c": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        self.trained = False

    def _run(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps x rows x units) of one direction over x (rows x steps)."""
        h = c = np.zeros((len(x), HIDDEN), self.w["c"].dtype)
        out, held = np.empty((x.shape[1], *h.shape), h.dtype), []
        wx, wh = self.w[f"x{side}"], self.w[f"h{side}"]
        for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
            gates = wx[x[:, t]] + h @ wh
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
            u = np.tanh(gates[:, 3 * HIDDEN :])
            before, c = c, f * c + i * u
            if keep:
                held.append((t, h, before, i, f, o, u, c))
            h = o * np.tanh(c)
            out[t] = h
        return out, held

    def scores(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, s, False)[0] for s in "fb"], 2)
        return both @ self.w["o"] + self.w["c"]

    def decode(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best paths (Viterbi) of stretches that are cut in blocks: tags of blocks x STEP.

        Blocks of a stretch follow each other, first tells where one begins. Each block is solved for every tag before it, all
        at once; then blocks are joined in order. So a long stretch is no long loop, and the path is the best of the whole.
        """
        n, steps, k = score.shape
        move, rows = self.w["move"], np.arange(n)
        best = np.where(first[:, None, None], self.w["start"], move) + score[:, 0, None, :]
        came = np.zeros((steps, n, k, k), np.int8)
        for t in range(1, steps):
            reach = best[:, :, :, None] + move
            came[t] = reach.argmax(2)
            best = reach.max(2) + score[:, t, None, :]
        entry = np.zeros((n, k), np.int64)  # the best tag before the block for each of its last tags
        total = np.empty((n, k))
        begin = np.flatnonzero(first)
        turn = rows - begin[np.cumsum(first) - 1]
        order = np.argsort(turn, kind="stable")
        for at in np.split(order, np.cumsum(np.bincount(turn))[:-1]):
            reach = best[at] + np.where(first[at], 0.0, 1.0)[:, None, None] * total[at - 1][:, :, None]
            entry[at], total[at] = reach.argmax(1), reach.max(1)
        last = np.empty(n, np.int64)
        ends = np.append(first[1:], True)
        last[ends] = total[ends].argmax(1)
        for at in np.split(order, np.cumsum(np.bincount(turn))[:-1])[:0:-1]:
            last[at - 1] = entry[at, last[at]]
        tags, before = np.empty((n, steps), np.int64), entry[rows, last]
        tags[:, -1] = last
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = came[t][rows, before, tags[:, t]]
        return tags

    def _crf(self, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the log-likelihood by scores, transitions and start, by forward-backward."""
        n, steps = len(y), len(score)
        emit, step = np.exp(score - score.max(2, keepdims=True)), np.exp(self.w["move"])
        ahead, back = np.empty_like(emit), np.ones_like(emit)
        ahead[0] = emit[0] * np.exp(self.w["start"])
        ahead[0] /= ahead[0].sum(1, keepdims=True)
        for t in range(1, steps):
            ahead[t] = (ahead[t - 1] @ step) * emit[t]
            ahead[t] /= ahead[t].sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            back[t] = (emit[t + 1] * back[t + 1]) @ step.T
            back[t] /= back[t].sum(1, keepdims=True)
        given = ahead * back
        given /= given.sum(2, keepdims=True)
        off = -given
        off[np.arange(steps)[:, None], np.arange(n), y.T] += 1
        pair = np.zeros_like(self.w["move"])
        for t in range(1, steps):
            joint = ahead[t - 1][:, :, None] * step * (emit[t] * back[t])[:, None, :]
            pair -= (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        np.add.at(pair, (y[:, :-1], y[:, 1:]), 1)
        return off, pair, off[0].sum(0)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.02, seed: int = 6) -> Tagger:
        """Adam on the conditional likelihood of the tag sequences y (rows x steps) of x."""
        if not len(x):
            return self
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for turn in range(1, steps + 1):
            pick = rng.integers(len(x), size=BATCH)
            slope = self._slope(x[pick], y[pick])
            for k, g in slope.items():
                g = np.clip(g / BATCH, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] += rate * min(1, 2 - 2 * turn / (steps + 1)) * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.trained = True
        return self

    def _slope(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {s: self._run(x, s, True) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], 2)
        off, move, start = self._crf(both @ self.w["o"] + self.w["c"], y)
        out = {"o": np.einsum("tnh,tnk->hk", both, off), "c": off.sum((0, 1)), "move": move, "start": start}
        into = off @ self.w["o"].T
        for s, part in zip("fb", (into[:, :, :HIDDEN], into[:, :, HIDDEN:]), strict=True):
            wh = self.w[f"h{s}"]
            gx, gh = np.zeros_like(self.w[f"x{s}"]), np.zeros_like(wh)
            dh = dc = 0.0
            for t, h, before, i, f, o, u, c in reversed(runs[s][1]):
                dh = dh + part[t]
                tc = np.tanh(c)
                dc = dc + dh * o * (1 - tc * tc)
                gates = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
                np.add.at(gx, x[:, t], gates)
                gh += h.T @ gates
                dh, dc = gates @ wh.T, dc * f
            out |= {f"x{s}": gx, f"h{s}": gh}
        return out

    def spans(self, classes: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
        """Spans of each text, from the reconciled tags of its windows."""
        starts, windows = [], []
        for own in classes:
            triggers = np.flatnonzero((own == 1) | (own == 6))
            at = window_starts(triggers, len(own)) if len(triggers) else np.zeros(0, np.int64)
            starts.append(at)
            padded = np.concatenate([own, np.zeros(max(0, WINDOW - len(own)), np.int64)])
            windows.append(padded[at[:, None] + np.arange(WINDOW)])
        if not self.trained or not any(len(x) for x in windows):
            return [[] for _ in classes]
        rows = np.concatenate(windows)
        weight = 1.0 + np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))  # those from the middle count most
        out: list[list[tuple[int, int, str]]] = []
        done = 0
        for own, at in zip(classes, starts, strict=True):
            said = np.zeros(len(own), np.int64)
            if len(at):
                said = self._whole(rows[done : done + len(at)], at, len(own), weight)
            done += len(at)
            out.append(_read(said))
        return out

    def _whole(self, rows: np.ndarray, at: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
        """The tags of a text of n characters from its windows; outside where no window lies.

        Blocks of STEP characters are the union of the windows' halves, so a stretch is a run of blocks.
        """
        size = -(-max(int(at[-1]) + WINDOW, n) // STEP) * STEP
        total, held = np.zeros((size, TAGS), np.float32), np.zeros(size, np.float32)
        for low in range(0, len(rows), 1024):
            score = self.scores(rows[low : low + 1024])
            for k, a in enumerate(at[low : low + 1024].tolist()):
                total[a : a + WINDOW] += score[:, k] * weight[:, None]
                held[a : a + WINDOW] += weight
        covered = held > 0
        covered[n:] = False
        total[covered] /= held[covered, None]
        total[~covered] = np.array([0.0, *[-1e4] * (TAGS - 1)])  # outside
        block = np.flatnonzero(covered.reshape(-1, STEP).any(1))
        first = np.append(True, block[1:] != block[:-1] + 1)
        said = np.zeros(size, np.int64)
        tags = said.reshape(-1, STEP)
        for low, high in _batches(first, 2048):
            tags[block[low:high]] = self.decode(total.reshape(-1, STEP, TAGS)[block[low:high]], first[low:high])
        return said[:n]


def _batches(first: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole stretches of about so many blocks (a longer stretch is one of its own)."""
    begins, low = np.append(np.flatnonzero(first), len(first)), 0
    while low < len(first):
        high = int(begins[max(np.searchsorted(begins, low + size, "right") - 1, np.searchsorted(begins, low) + 1)])
        yield low, high
        low = high


def _read(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of a tag sequence: a begin and the insides of its kind that follow; a stray inside begins one."""
    out = []
    at = np.flatnonzero(tags)
    k = 0
    while k < len(at):
        start, kind = int(at[k]), (int(tags[at[k]]) - 1) // 2
        end = start + 1
        k += 1
        while k < len(at) and at[k] == end and tags[end] == 2 + 2 * kind:
            end += 1
            k += 1
        out.append((start, end, KINDS[kind]))
    return out


def _credible(text: str, start: int, end: int, kind: str, base: list[tuple[int, int, str]]) -> bool:
    """A span of the network counts if it is apart from the patterns' spans, whole at both ends, and can be read as its kind.

    Separators, spaces and brackets may be any; what is left of digits and letters must make sense.
    """
    if any(start < e and s < end for s, e, _ in base):
        return False
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    part = text[start:end]
    if re.search(r"\s{2}|[\n\t]", part):
        return False
    if kind == "email":
        left, _, right = re.sub(r"[\[\](){}\s]", "", part).partition("@")
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+", left) and re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", right))
    numbers = re.findall("[0-9]+", part)
    digits = sum(map(len, numbers))
    if any(c.isalpha() for c in part):
        return False
    if kind == "card":
        return 13 <= digits <= 19 and len(numbers) >= 3 and _luhn("".join(numbers))
    if kind == "ip":
        return len(numbers) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in numbers) and part[0].isdigit() and part[-1].isdigit()
    return 10 <= digits <= 15 and (part[0] == "(" or len(numbers) >= 3) and not re.match(r"(19|20)[0-9]{2}\D", part)


#: Ways to write a span that the patterns don't take, by kind: what stands for a separator of the span, or None to leave it out.
_FORMS = {
    "email": ({"@": " @ "}, {".": "[.]"}, {"@": "(@)"}, {"@": "[@]", ".": "[.]"}, {".": " . "}),
    "ip": ({".": "[.]"}, {".": " . "}, {".": "(.)"}, {".": "-"}),
    "card": ({"": "."}, {"": "/"}, {"": "_"}, {"": " - "}),
    "phone": ({"+": None}, {"+": None, " ": "."}, {"+": None, " ": "-", "(": None, ")": None}, {"+": None, "-": "/"}),
}
#: Things with digits that are no personal data.
_OTHERS = ("20{0:02d}-{1:02d}-{2:02d}", "{0}.{1}", "{0:02d}:{1:02d}:{2:02d}", "v{0}.{1}.{2}", "{0},{1:03d},{2:03d}", "{0}{1:02d}{2:02d}", "({0})", "{0}/{1}", "{0}.{1}.{2}", "{0}%", "{0}-{1}", "no. {0}{1:03d}")


def variant(span: str, kind: str, form: int) -> str:
    """The span in one of the forms that the patterns don't know."""
    held = _FORMS[kind][form % len(_FORMS[kind])]
    if kind == "card":  # digits by fours, with the separator between
        digits = re.sub("[^0-9]", "", span)
        return held[""].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return "".join(c if c not in held else held[c] or "" for c in span).strip(" .-/")


def varied(text: str, turn: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with some of its patterns' spans in other forms or replaced by other things with digits, and its spans then."""
    out, spans, done, size = [], [], 0, 0
    for k, (start, end, kind) in enumerate(base_spans(text)):
        if start < done:
            continue
        mixed = (turn ^ (k * 0x9E3779B97F4A7)) * 0xD1342543DE82EF95 % (1 << 64)
        draw = [mixed >> x & 63 for x in (58, 52, 46, 40)]
        size += start - done
        part = text[start:end]
        if draw[0] < 28:
            part = variant(part, kind, draw[1])
        elif draw[0] < 40:
            part, kind = _OTHERS[draw[1] % len(_OTHERS)].format(draw[2] % 24 + 1, draw[3] % 28 + 1, (draw[2] + draw[3]) % 28 + 1), ""
        out += [text[done:start], part]
        if kind:
            spans.append((size, size + len(part), kind))
        size, done = size + len(part), end
    return "".join([*out, text[done:]]), spans


def has_trigger(text: Column) -> Column:
    """Whether a text has a digit or @, which every span of every kind has."""
    return F.coalesce(text.rlike("[0-9@]"), F.lit(False))


def labelled_windows(docs: DataFrame, key: str, text: str, at_most: int) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of at most so many windows, by the order of hashes: of texts as they are and with their spans in other forms.

    Every window about a digit or @ of a text in the sample may be taken, wherever it lies; short texts are filled up with nulls.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for form, (said, spans) in enumerate(((text_, base_spans(text_)), varied(text_, turn), varied(text_, ~turn))):
                    own, tags = char_classes(said), tags_of(len(said), spans)
                    fill = max(0, WINDOW - len(own))
                    own, tags = np.pad(own, (0, fill)), np.pad(tags, (0, fill))
                    for a in window_starts(np.flatnonzero((own == 1) | (own == 6)), len(own)).tolist():
                        x, y = own[a : a + WINDOW].astype(np.int8), tags[a : a + WINDOW].astype(np.int8)
                        rank = (turn ^ (form + 3 * a + 1) * 0x9E3779B97F4A7C15) * 0xD1342543DE82EF95 % (1 << 63)
                        rows.append((rank // 8 if y.any() else rank, x.tobytes(), y.tobytes()))  # windows with a span come first, eight to one
                    if len(rows) > 10_000:
                        rows = sorted(rows)[:at_most]
                columns = list(zip(*sorted(rows)[:at_most], strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["turn", "x", "y"])

    # Windows are cut from texts whose hash comes first; about one text in sixteen is thought to have a digit or @.
    rows = tx.sample_by_hash(docs.select(key, text), key, 31, at_most, 16).where(has_trigger(F.col(text))).select("turn", F.col(text).alias("text"))
    found = rows.mapInArrow(tx.lean(cut), "turn long, x binary, y binary").orderBy("turn", "x").limit(at_most).collect()
    shape = lambda k: np.frombuffer(b"".join(bytes(r[k]) for r in found), np.int8).reshape(-1, WINDOW).astype(np.int64)
    return shape("x"), shape("y")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> Tagger:
    """A tagger of the labelled spans in a bounded sample of windows."""
    out = Tagger().fit(*labelled_windows(docs, key, text, windows), steps)
    tx.trim()
    return out


def _spans_of(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str, bool]]]:
    base = [base_spans(t) for t in texts]
    said = tagger.spans([char_classes(t) for t in texts])
    out = []
    for text, own, more in zip(texts, base, said, strict=True):
        extra = [(s, e, k, False) for s, e, k in more if _credible(text, s, e, k, own)]
        out.append(sorted([(*x, True) for x in own] + extra, key=lambda x: (x[0], KINDS.index(x[2]))))
    return out


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """key, spans (kind, start, end in code points, and whether a pattern found it) and redacted (<KIND> in place of spans).

    A null text has no spans, and null stays null when redacted; overlapping spans are redacted together,
    named after the first. Spans come by start, then kind as listed. Repeated rows get a row each, an empty table
    gives an empty one, and further columns are not read; with carry, the whole input row comes along as a struct, row.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, clean = tx.text_of(batch, 2, place).to_pylist(), [], []
            hit = batch.column(1).to_pylist()
            for low in range(0, len(texts), 64):
                rows = [k for k in range(low, min(low + 64, len(texts))) if hit[k]]
                spans = dict(zip(rows, _spans_of([texts[k] for k in rows], tagger), strict=True))
                for k in range(low, min(low + 64, len(texts))):
                    found.append([{"kind": x[2], "start": x[0], "end": x[1], "base": x[3]} for x in spans.get(k, ())])
                    clean.append(_redact(texts[k], spans[k]) if spans.get(k) else texts[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS_TYPE), pa.array(clean, pa.string()), *(c for c in batch.columns[2:] if carry)], ["key", "spans", "redacted", *["row"] * carry])

    place = docs.columns.index(text) if carry else None
    rows = docs.select(F.col(key).cast("long").alias("key"), has_trigger(F.col(text)).alias("hit"), *tx.carried(docs, carry, text))
    return tx.arrow_map(rows, emit, tx.with_row(f"key long, spans {_SPANS}, redacted string", docs, carry)).withColumnRenamed("key", key)


def _redact(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    out, done = [], 0
    for start, end, kind, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the patterns' spans by kind, their digest, and all spans, as strings of kind:start:end."""
    named = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(F.encode(named(base), "UTF-8"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
