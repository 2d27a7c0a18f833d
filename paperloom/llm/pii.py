"""Personal data: fixed patterns, and spans that a linear-chain conditional random field adds.

The field's states are O and the kinds of personal data. Its features are the shapes of a word and of its neighbours
(letters, digits and punctuation in collapsed runs, digit runs by length) and a few cue words. It is trained by gradient
steps on a small labelled table made from templates, and decoded by Viterbi over the lines of many texts at once.

Words whose shapes have the same features share an emission row, so scoring a word is a table look-up.

The labelled table (``labelled_table``) is made from templates, 500 lines: English cue words, spellings of numbers and
addresses that the templates know, and look-alikes that are none. Names, postal addresses, dates of birth and other kinds
are not in it and so not found; a spelling that no template resembles may be missed, and nothing is added that fails the
exact check of its kind.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, sliced

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
STATES = ("O", *KINDS)
EMAIL_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL_REST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: From the start of a run of local-part characters; and, just after a match, from where it ended.
EMAIL = re.compile(rf"(?<!{EMAIL_LOCAL}){EMAIL_LOCAL}++@{EMAIL_REST}")
EMAIL_NEXT = re.compile(rf"{EMAIL_LOCAL}++@{EMAIL_REST}")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def octets(s: str) -> bool:
    """Whether all parts are at most 255, however many digits they have."""
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind, by kind and then start."""
    out = []
    if "@" in text:
        at = 0
        while m := (EMAIL_NEXT.match(text, at) if at else None) or EMAIL.search(text, at):
            out.append(("email", *m.span()))
            at = m.end()
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m[0])]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


#: Marks that no span holds but an edge; words end after them, as at white space.
MARKS = ":=,;|"
_WORD = re.compile(rf"[^\s{MARKS}]*[{MARKS}]|[^\s{MARKS}]+")


def spaced(text: str) -> str:
    """text with a space after every mark, so that split() gives the words."""
    for c in MARKS:
        text = text.replace(c, c + " ")
    return text


# The labelled table.

#: Words beside personal data.
CUES = frozenset("mail email e-mail at dot contact write address ip host server card visa credit number phone tel telephone call mobile fax ssn social security iban account bank".split())
_FILL = "the of and to in le la de et un der die und das ein el los que por con here there today report system item value page then thing other".split()


def labelled_table(n: int = 500, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """(words, states) of n short lines: personal data in many spellings, and look-alikes that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: r.choice(_FILL) if r.random() < 0.6 else "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 11)))
    name = lambda: "".join(r.choice("abcdeghiklmnorst") for _ in range(r.randint(3, 8)))
    end = lambda: r.choice(["com", "org", "net", "de", "fr", "es"])
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    make = {
        "email": [lambda: f"{name()}.{d(2)}@{name()}{d(1)}.example.{end()}", lambda: f"{name()}@{name()}.{end()}", lambda: f"{name()} at {name()} dot {end()}", lambda: f"{name()} [at] {name()}.{end()}", lambda: f"{name()}(at){name()}.{end()}"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))],
        "card": [lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(4)} {d(6)} {d(5)}"],
        "phone": [lambda: f"+{d(2)} {d(3)} {d(4)} {d(4)}", lambda: f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(11)}"],
        "ssn": [lambda: f"{d(3)}-{d(2)}-{d(4)}"],
        "iban": [lambda: f"DE{d(20)}", lambda: f"FR{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"ES{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}"],
    }
    cue = {"email": ["mail", "email:", "contact", "write to"], "ip": ["ip", "host", "server"], "card": ["card", "visa", "card number"], "phone": ["call", "phone:", "tel", "mobile"], "ssn": ["ssn", "ssn:", "social security number"], "iban": ["iban", "account", "iban:"]}
    none = [lambda: str(r.randint(0, 99999)), lambda: f"{d(2)}.{d(2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"token = \"{hexa(40)}\"", lambda: hexa(32), lambda: f"{d(1)},{d(3)}", lambda: "$$$", lambda: "###", lambda: f"{word()}***", lambda: f"{word()}&&&", lambda: f"{word().upper()}!!", lambda: "| " + word(), lambda: f"https://{name()}.{end()}/{d(3)}", lambda: f"{d(2)}%", lambda: f"at {word()}", lambda: f"dot {word()}", lambda: "+", lambda: "-", lambda: f"({d(4)})", lambda: f"{word().capitalize()}.", lambda: f"AKIA{d(6)}", lambda: f"{d(3)} {d(2)}", lambda: d(9), lambda: d(14)]
    out = []
    for _ in range(n):
        words, states = [], []
        put = lambda s, k: (words.extend(_WORD.findall(s)), states.extend([k] * len(_WORD.findall(s))))
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 4)):
                put(word(), "O")
            if r.random() < 0.45:
                put(r.choice(none)(), "O")
            else:
                k = r.choice(KINDS)
                if r.random() < 0.4:
                    put(r.choice(cue[k]), "O")
                s = r.choice(make[k])()
                put(s + r.choice(["", "", ".", ",", "###", "$$$", "&&&"]), k)
        for _ in range(r.randint(0, 3)):
            put(word(), "O")
        out.append((words, states))
    return out


# Features.

_RUNS = re.compile(r"0+|(\D)\1+")
_SHAPE = {i: "0" for i in range(48, 58)} | {i: "A" for i in range(65, 91)} | {i: "a" for i in range(97, 123)} | {ord(c): c for c in ".-+@()/:="}
_EDGES = "\"'`.,;:!?<>{}#$%&*|~^="


class _Shapes(dict):
    def __missing__(self, c: int) -> str:
        s = "a" if chr(c).isalpha() else "*"
        self[c] = s
        return s


_TABLE = _Shapes(_SHAPE)


def shape(word: str) -> str:
    """Collapsed character classes; digit runs as their length up to 6, 8 for 7 to 11, 9 for more. Edge marks go."""
    core = word.strip(_EDGES)
    if core.isalpha():
        low = core.lower()
        return f"cue:{low}" if low in CUES else "a"
    return _RUNS.sub(lambda m: m[1] if m[1] else str(len(m[0])) if len(m[0]) <= 6 else "8" if len(m[0]) <= 11 else "9", core.translate(_TABLE))


def features_of(shape_: str) -> list[str]:
    if shape_.startswith("cue:") or shape_ in ("a", ""):
        return [shape_ or "mark"]
    kinds = "".join(sorted(set("d" if c.isdigit() else c for c in shape_)))
    return [f"s={shape_}", f"k={kinds}", f"first={shape_[0]}", f"runs={min(6, sum(c.isdigit() for c in shape_))}"]


class Crf:
    """Weights per feature, position (-1, 0, 1) and state; and transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.names, self.weights, self.transitions = names, weights, transitions
        self.row_of: dict[tuple[int, ...], int] = {}
        self.rows = [np.zeros((0, len(STATES)), np.float32) for _ in range(3)]
        self.word_id: dict[str, int] = {}

    def __getstate__(self):
        return self.names, self.weights, self.transitions

    def __setstate__(self, state):
        self.__init__(*state)

    def ids(self, words: list[str]) -> np.ndarray:
        """The emission row of each word. Words whose shapes have the same known features share a row, so that the rows
        are bounded by the model and not by the texts; rows of long words aren't remembered by word."""
        known = self.word_id
        if len(known) > 300_000:
            known.clear()
        long: dict[str, int] = {}
        for w in set(words).difference(known):
            at = tuple(self.names[f] for f in features_of(shape(w)) if f in self.names)
            (known if len(w) <= 64 else long)[w] = self.row_of.setdefault(at, len(self.row_of))
        new = list(self.row_of)[len(self.rows[0]) :]
        if new:
            for k in range(3):
                more = np.array([self.weights[k, list(at)].sum(axis=0) for at in new], dtype=np.float32).reshape(-1, len(STATES))
                self.rows[k] = np.vstack([self.rows[k], more])
        find = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        return np.fromiter(map(find, words), np.int64, len(words))

    def decode(self, words: list[str], lengths: list[int]) -> np.ndarray:
        """The best state of each word; lengths are those of the lines that words holds one after the other."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int8)
        ids, length = self.ids(words), np.array(lengths)
        length = length[length > 0]
        start = np.cumsum(length) - length
        e = self.rows[1][ids]
        inner = np.ones(n, bool)
        inner[start] = False  # a line's first word has none before it
        e[inner] += self.rows[0][ids[np.flatnonzero(inner) - 1]]
        inner = np.ones(n, bool)
        inner[start + length - 1] = False
        e[inner] += self.rows[2][ids[np.flatnonzero(inner) + 1]]
        # Viterbi, step by step over all lines, longest first, so that the lines still going on are a prefix.
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        going = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lines longer than t
        back = np.zeros((n, len(STATES)), np.int8)
        score = e[start]
        last = np.empty((len(start), len(STATES)), np.float32)
        last[:] = score
        to = np.ascontiguousarray(self.transitions.T)  # [to, from]
        for t in range(1, length[0]):
            k = going[t]
            both = score[:k, None, :] + to
            best = both.argmax(axis=2)
            back[start[:k] + t] = best
            score = np.take_along_axis(both, best[:, :, None], 2)[:, :, 0] + e[start[:k] + t]
            last[:k] = score
        out = np.zeros(n, np.int8)
        state = last.argmax(axis=1)
        at = start + length - 1
        out[at] = state
        for t in range(length[0] - 1, 0, -1):
            k = going[t]
            # lines of t + 1 words or more: step back from word t
            state[:k] = back[start[:k] + t, state[:k]]
            out[start[:k] + t - 1] = state[:k]
        return out


def train(table: list[tuple[list[str], list[str]]], rounds: int = 100, reg: float = 0.05, rate: float = 0.15) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam steps on the whole table; forward and backward in numpy."""
    table = [(w, s) for w, s in table if w]
    names: dict[str, int] = {}
    for words, _ in table:
        for w in words:
            for f in features_of(shape(w)):
                names.setdefault(f, len(names))
    k, b, longest = len(STATES), len(table), max(len(w) for w, _ in table)
    length = np.array([len(w) for w, _ in table])
    gold = np.zeros((b, longest), np.int64)
    rows, cols, pos, feat = [], [], [], []
    for i, (words, states) in enumerate(table):
        gold[i, : len(words)] = [STATES.index(s) for s in states]
        each = [[names[f] for f in features_of(shape(w))] for w in words]
        for t in range(len(words)):
            for p in (-1, 0, 1):
                if 0 <= t + p < len(words):
                    for f in each[t + p]:
                        rows.append(i), cols.append(t), pos.append(p + 1), feat.append(f)
    rows, cols, pos, feat = map(np.array, (rows, cols, pos, feat))
    mask = np.arange(longest)[None] < length[:, None]
    w, tr = np.zeros((3, len(names), k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (w, w, tr, tr)]
    gold_one = np.eye(k)[gold] * mask[:, :, None]
    gold_tr = np.zeros((k, k))
    np.add.at(gold_tr, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for step in range(1, rounds + 1):
        e = np.zeros((b, longest, k))
        np.add.at(e, (rows, cols), w[pos, feat])
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            nxt = lse(alpha[:, t - 1, :, None] + tr[None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            nxt = lse(tr[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        grad_e = p - gold_one
        grad_tr = -gold_tr
        for t in range(1, longest):
            on = mask[:, t]
            grad_tr = grad_tr + np.exp(alpha[on, t - 1, :, None] + tr[None] + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None]).sum(axis=0)
        grad_w = np.zeros_like(w)
        np.add.at(grad_w, (pos, feat), grad_e[rows, cols])
        for x, g, m, v in ((w, grad_w, state[0], state[1]), (tr, grad_tr, state[2], state[3])):
            g = g + reg * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(names, w.astype(np.float32), tr.astype(np.float32))


@functools.cache
def default_model() -> Crf:
    return train(labelled_table())


# Spans.

_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}")
_WRITTEN_AT = re.compile(r"[A-Za-z0-9._%+-]+(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)")


def plausible(kind: str, s: str) -> bool:
    """An exact check of a span that the field proposes."""
    d = digits_of(s)
    if kind == "email":
        return bool(_WRITTEN_AT.fullmatch(s))
    if kind == "ip":
        return bool(IP.fullmatch(s)) and octets(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^\d -]", s)
    if kind == "phone":
        return 7 <= len(d) <= 15 and not re.search(r"[^\d\s+().-]", s) and bool(re.search(r"[\s().-]|\+", s))
    if kind == "ssn":
        return bool(_SSN.fullmatch(s))
    if kind == "iban":
        c = s.replace(" ", "")
        return 15 <= len(c) <= 34 and bool(_IBAN.fullmatch(s)) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
    return False


TEXT_AT_ONCE = 2_000_000


#: Digits (letters too in an IBAN) of the longest span of a kind.
LONGEST = {"ip": 12, "card": 19, "phone": 15, "ssn": 9, "iban": 34}
_ALNUM = re.compile(r"[^\W_]")
_WRITTEN_IN = re.compile(rf"(?<!{EMAIL_LOCAL}){_WRITTEN_AT.pattern.replace(']+', ']++', 1)}")


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    s = text[a:b]
    lead = len(s) - len(s.lstrip(_EDGES + "[]"))
    return a + lead, a + lead + len(s.strip(_EDGES + "[]"))


def parts(kind: str, text: str, places: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of kind in a run of neighbouring words of one state: the whole if it is plausible, else the plausible parts.

    The field has no state for a beginning, so a run may hold several items. Marks part them; between marks the parts are
    those whole words that cover most letters and digits, with the fewest spans, and brackets or plus signs at their start.
    """
    a, b = trimmed(text, places[0][0], places[-1][1])
    if plausible(kind, text[a:b]):
        return [(kind, a, b)]
    if kind == "email":
        found = (trimmed(text, *(x + a for x in m.span())) for m in _WRITTEN_IN.finditer(text[a:b]))
        return [(kind, i, j) for i, j in found if plausible(kind, text[i:j])]
    out = []
    cuts = [0, *(n + 1 for n, p in enumerate(places) if text[p[1] - 1] in MARKS), len(places)]
    for own in (places[x:y] for x, y in zip(cuts, cuts[1:])):
        size = [len(_ALNUM.findall(text[i:j])) for i, j in own]
        best: list[tuple[tuple[int, int, int], list]] = [((0, 0, 0), [])]  # of the first n words: score; last span and what is before it
        for n in range(1, len(own) + 1):
            best.append(best[n - 1])
            total = 0
            for m in range(n - 1, max(-1, n - 1 - 2 * LONGEST[kind]), -1):
                total += size[m]
                if total > LONGEST[kind]:
                    break
                i, j = trimmed(text, own[m][0], own[n - 1][1])
                covered, spans, inner = best[m][0]
                score = (covered + total, spans - 1, inner - sum(c in "+(" for c in text[i + 1 : j]))
                if size[m] and size[n - 1] and score > best[n][0] and plausible(kind, text[i:j]):
                    best[n] = (score, [(kind, i, j), best[m][1]])
        last, found = best[-1][1], []
        while last:
            found.append(last[0])
            last = last[1]
        out += found[::-1]
    return out


def field_spans(crf: Crf, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Per text, the spans that the field finds and that pass their check; lines are the field's sequences."""
    words: list[str] = []
    lengths: list[int] = []
    first, lines = [], []
    for t in texts:
        first.append(len(words))
        lines.append(own := [line.split() for line in spaced(t).split("\n")])
        for w in own:
            words += w
            lengths.append(len(w))
    first.append(len(words))
    states = crf.decode(words, lengths)
    found = np.flatnonzero(states)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k in np.unique(np.searchsorted(first, found, side="right") - 1).tolist():
        own = states[first[k] : first[k + 1]]
        line_of = np.repeat(np.arange(len(lines[k])), [len(w) for w in lines[k]])
        places = [m.span() for m in _WORD.finditer(texts[k])]
        i = 0
        while i < len(own):
            j = i + 1
            if own[i]:
                while j < len(own) and own[j] == own[i] and line_of[j] == line_of[i]:
                    j += 1
                out[k] += parts(STATES[own[i]], texts[k], places[i:j])
            i = j
    return out


def scan(crf: Crf, texts: list[str | None]) -> list[tuple[list, list]]:
    """Per text (base spans, all spans): a span of the field is added unless a base span overlaps it."""
    out: list[tuple[list, list]] = []
    now: list[str] = []
    size = 0
    for n, t in enumerate(texts):
        now.append(t or "")
        size += len(now[-1])
        if size >= TEXT_AT_ONCE or n + 1 == len(texts):
            for t_, extra in zip(now, field_spans(crf, now)):
                base = base_spans(t_)
                every = base + [s for s in extra if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
                out.append((base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))))
            now, size = [], 0
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in brackets; of overlapping spans the first, and then the longest."""
    parts, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{k.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (text), found
    (array of structs), masked_text.

    Offsets are code points, ends exclusive. Null text: no spans, and masked_text is null. Null ids stay null, repeated
    rows repeat, an empty table gives no rows; other columns of docs are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(crf or default_model())  # weights of the table's features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in sliced(batches, 1):
            texts = b.column(1).to_pylist()
            counts, digest, spans, found, clean = ([], [], [], []), [], [], [], []
            for t, (base, every) in zip(texts, scan(model, texts)):
                for c, k in zip(counts, KINDS):
                    c.append(sum(s[0] == k for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                found.append([{"kind": k, "start": i, "end": j} for k, i, j in every])
                clean.append(None if t is None else masked(t, every) if every else t)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(found, kind), pa.array(clean, pa.string())], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found", "masked_text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>, masked_text string")


def mask(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", crf: Crf | None = None) -> DataFrame:
    """docs with personal data in text_col replaced by its kind, and length_col (if there) set to the new length in code
    points. All rows and other columns stay, null texts stay null."""
    ship(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(crf or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in sliced(batches, at):
            texts = b.column(at).to_pylist()
            clean = [t if t is None or not every else masked(t, every) for t, (_, every) in zip(texts, scan(model, texts))]
            columns = list(b.columns)
            columns[at] = pa.array(clean, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    out = docs.mapInArrow(run, schema)
    if length_col not in docs.columns:
        return out
    new = F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(schema[length_col].dataType))
    return out.withColumn(length_col, new)
