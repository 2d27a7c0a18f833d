"""Functions of the file format: sampled (0), exponential (2), stitching (3) and calculator (4). Plain Python, no Spark."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from .objects import END, Keyword, Parser, PdfError, Stream, decode_stream

#: Limits: inputs of a sampled function, depth of functions within functions, and work and stack of a calculator.
MAX_INPUTS, MAX_DEPTH, MAX_STEPS, MAX_STACK = 8, 16, 100_000, 100
Function = Callable[[list[float]], list[float]]


def _pairs(flat: list) -> list[tuple[float, float]]:
    return [(float(a), float(b)) for a, b in zip(flat[::2], flat[1::2])]


def _clip(values: list[float], ranges: list[tuple[float, float]]) -> list[float]:
    return [min(max(v, lo), hi) for v, (lo, hi) in zip(values, ranges)] if ranges else values


def _between(x: float, a: float, b: float, c: float, d: float) -> float:
    return c if a == b else c + (x - a) * (d - c) / (b - a)


def function(pdf, o, depth: int = 0) -> Function:
    """What a function object computes; an array of functions of one result each is one of several. Errors are PdfErrors."""
    found = pdf.get(o)
    if depth > MAX_DEPTH:
        raise PdfError("functions nested too deeply")
    if isinstance(found, list):
        parts = [function(pdf, x, depth + 1) for x in found]
        return lambda v: [y for f in parts for y in f(v)]
    d = found.dict if isinstance(found, Stream) else found if isinstance(found, dict) else {}
    numbers = lambda key: [float(x) for x in map(pdf.get, pdf.list(d.get(key))) if isinstance(x, (int, float))]
    domain, out_range = _pairs(numbers("Domain")), _pairs(numbers("Range"))
    kind = pdf.get(d.get("FunctionType"))
    if not domain:
        raise PdfError("a function without a domain")
    if kind == 0:
        inner = _sampled(pdf, found, numbers, domain, out_range)
    elif kind == 2:
        inner = _exponential(pdf, d, numbers)
    elif kind == 3:
        inner = _stitched(pdf, d, numbers, domain, depth)
    elif kind == 4 and isinstance(found, Stream):
        inner = calculator(decode_stream(found, pdf.get))
    else:
        raise PdfError(f"no function of type {kind}")
    return lambda v: _clip(inner(_clip([float(x) for x in v], domain)), out_range)


def _sampled(pdf, s, numbers, domain, out_range) -> Function:
    size, bits = [int(x) for x in numbers("Size")], pdf.get(s.dict.get("BitsPerSample"))
    m, n = len(domain), len(out_range)
    if m > MAX_INPUTS or len(size) != m or not n or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or min(size) < 1:
        raise PdfError("bad sampled function")
    encode = _pairs(numbers("Encode")) or [(0.0, k - 1.0) for k in size]
    decode = _pairs(numbers("Decode")) or out_range
    raw = decode_stream(s, pdf.get)
    total = math.prod(size) * n
    if len(raw) * 8 < total * bits:
        raise PdfError("too few samples")
    whole, length = int.from_bytes(raw, "big") if bits not in (8, 16) else 0, len(raw) * 8
    top = float((1 << bits) - 1)

    def sample(i: int) -> float:
        if bits == 8:
            return raw[i] / top
        if bits == 16:
            return int.from_bytes(raw[2 * i : 2 * i + 2], "big") / top
        return (whole >> (length - (i + 1) * bits) & (1 << bits) - 1) / top

    strides = [math.prod(size[:k]) for k in range(m)]

    def run(v: list[float]) -> list[float]:
        low, part = [], []
        for x, (a, b), (c, e), k in zip(v, domain, encode, size):
            at = min(max(_between(x, a, b, c, e), 0.0), k - 1.0)
            low.append(min(int(at), max(0, k - 2)))
            part.append(at - low[-1])
        out = [0.0] * n
        for corner in itertools.product((0, 1), repeat=m):
            weight = math.prod(p if c else 1 - p for c, p in zip(corner, part))
            if weight:
                base = sum((a + c) * s_ for a, c, s_ in zip(low, corner, strides)) * n
                for j in range(n):
                    out[j] += weight * sample(base + j)
        return [_between(y, 0.0, 1.0, *decode[j]) for j, y in enumerate(out)]

    return run


def _exponential(pdf, d, numbers) -> Function:
    c0, c1, power = numbers("C0") or [0.0], numbers("C1") or [1.0], pdf.get(d.get("N"))
    if not isinstance(power, (int, float)):
        raise PdfError("an exponential function without a power")

    def run(v: list[float]) -> list[float]:
        try:
            x = v[0] ** power
        except (ZeroDivisionError, OverflowError):
            x = 0.0
        x = 0.0 if isinstance(x, complex) else x
        return [a + x * (b - a) for a, b in zip(c0, c1)]

    return run


def _stitched(pdf, d, numbers, domain, depth) -> Function:
    parts = [function(pdf, x, depth + 1) for x in pdf.list(d.get("Functions"))]
    bounds, encode = numbers("Bounds"), _pairs(numbers("Encode"))
    if not parts or len(bounds) != len(parts) - 1 or len(encode) < len(parts):
        raise PdfError("bad stitching function")
    edges = [domain[0][0], *bounds, domain[0][1]]

    def run(v: list[float]) -> list[float]:
        k = min(sum(v[0] >= b for b in bounds), len(parts) - 1)
        return parts[k]([_between(v[0], edges[k], edges[k + 1], *encode[k])])

    return run


# The calculator.


def _whole(x) -> int:
    if isinstance(x, bool) or not float(x).is_integer():
        raise PdfError("a whole number is needed")
    return int(x)


def _logic(f):
    return lambda a, b: f(a, b) if isinstance(a, bool) and isinstance(b, bool) else f(_whole(a), _whole(b))


def _div(a, b):
    if b == 0:
        raise PdfError("division by zero")
    return a / b


def _shift(a, n):
    a, n = _whole(a), _whole(n)
    return (a << min(n, 64)) & 0xFFFFFFFF if n >= 0 else (a & 0xFFFFFFFF) >> min(-n, 64)


ONE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": lambda a: float(math.ceil(a)), "floor": lambda a: float(math.floor(a)), "round": lambda a: float(math.floor(a + 0.5)), "truncate": lambda a: float(math.trunc(a)),
    "sqrt": lambda a: math.sqrt(max(0.0, a)), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0,
    "cvi": lambda a: math.trunc(a), "cvr": float, "not": lambda a: (not a) if isinstance(a, bool) else ~_whole(a),
}
TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _div, "idiv": lambda a, b: math.trunc(_div(_whole(a), _whole(b))), "mod": lambda a, b: math.fmod(_whole(a), _whole(b)) if b else _div(a, b),
    "exp": lambda a, b: 0.0 if isinstance(y := a**b if a or b >= 0 else 0.0, complex) else y, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "and": _logic(lambda a, b: a & b), "or": _logic(lambda a, b: a | b), "xor": _logic(lambda a, b: a ^ b), "bitshift": _shift,
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
}


def calculator(program: bytes) -> Function:
    """A program in braces, over a stack of numbers and truth values."""
    p = Parser(program.replace(b"{", b" { ").replace(b"}", b" } "), refs=False)

    def block(depth: int) -> list:
        out = []
        while (o := p.next()) is not END and o != "}":
            if depth > MAX_DEPTH:
                raise PdfError("a program nested too deeply")
            out.append(block(depth + 1) if o == "{" else o)
        return out

    if p.next() != "{":
        raise PdfError("no program")
    code = block(0)

    def run(v: list[float]) -> list[float]:
        stack: list = list(v)
        steps = 0

        def pop():
            if not stack:
                raise PdfError("an empty stack")
            return stack.pop()

        def execute(words: list) -> None:
            nonlocal steps
            for i, w in enumerate(words):
                steps += 1
                if steps > MAX_STEPS or len(stack) > MAX_STACK:
                    raise PdfError("a program beyond its limits")
                if isinstance(w, list):
                    continue
                if not isinstance(w, Keyword):
                    stack.append(w)
                elif w in ONE:
                    stack.append(ONE[w](pop()))
                elif w in TWO:
                    b, a = pop(), pop()
                    stack.append(TWO[w](a, b))
                elif w == "pop":
                    pop()
                elif w == "exch":
                    b, a = pop(), pop()
                    stack.extend((b, a))
                elif w == "dup":
                    stack.extend([pop()] * 2)
                elif w == "copy":
                    n = _whole(pop())
                    if not 0 <= n <= len(stack):
                        raise PdfError("copy beyond the stack")
                    stack.extend(stack[len(stack) - n :])
                elif w == "index":
                    n = _whole(pop())
                    if not 0 <= n < len(stack):
                        raise PdfError("index beyond the stack")
                    stack.append(stack[-1 - n])
                elif w == "roll":
                    j, n = _whole(pop()), _whole(pop())
                    if not 0 <= n <= len(stack):
                        raise PdfError("roll beyond the stack")
                    if n:
                        own = stack[-n:]
                        j %= n
                        stack[-n:] = own[-j:] + own[:-j] if j else own
                elif w == "if":
                    if pop() is True and isinstance(words[i - 1], list):
                        execute(words[i - 1])
                elif w == "ifelse":
                    yes, no = words[i - 2], words[i - 1]
                    execute(yes if pop() is True else no)
                else:
                    raise PdfError(f"no operator {w}")

        execute(code)
        return [float(x) for x in stack]

    return run
