"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, address schemes and identifier
cues. A small parser for each kind then expands an anchor to the left and right and validates what it holds. Each parser
remembers where its last match ended, so the matches of a kind are the leftmost ones that do not overlap, and no character
is expanded twice. Anchors inside a stretch already parsed are passed over.

Kinds: email, ip, card and phone as fixed by their patterns; beyond these ``url`` (from a scheme to white space or a
quote, less closing marks, with a dotted or bracketed host) and ``account`` (after a cue such as ``token =``: 8 to 128
letters, digits and inner hyphens with at least 4 digits).

Cases: a null or empty text has no spans; very long texts are read whole; repeated rows give equal results; an empty table
gives no rows. Input columns named like an output are replaced by it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import packed, unpacked, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")

#: The characters of each kind, schemes and cues.
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = re.compile("[A-Za-z0-9-]*")
DIGIT_RUN = re.compile("[0-9]*")
PHONE_RUN = re.compile("[ ().0-9-]*")
HOST_END, HOST_INNER = re.compile("[/?#]"), re.compile(r"[^.]\.[^.]|\[[0-9A-Fa-f:]+")
URL_RUN = re.compile(r"[^\s<>\"'`]*")
CUE_GAP = re.compile(r"""[ \t]{0,3}[:=#]?[ \t]{0,3}["']?""")
ACCOUNT_RUN = re.compile("[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = (
    "account", "acct", "iban", "passport", "ssn", "customer", "member", "policy", "token", "secret", "password", "api_key",
)


def automaton():
    cache = worker_cache()
    if "anchors" not in cache:
        from ahocorasick import Automaton

        found = Automaton()
        found.add_word("@", ("email", 1))
        found.add_word("+", ("phone", 1))
        for d in DIGITS:
            found.add_word(d, ("digit", 1))
        for s in SCHEMES:
            for x in {s, s.upper(), s.capitalize()}:
                found.add_word(x, ("url", len(x)))
        for c in CUES:
            for x in {c, c.upper(), c.capitalize()}:
                found.add_word(x, ("account", len(x)))
        found.make_automaton()
        cache["anchors"] = found
    return cache["anchors"]


def luhn(digits: list[int]) -> bool:
    doubled = (2 * d - 9 if d > 4 else 2 * d for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def email(text: str, at: int, since: int) -> tuple[int, int] | None:
    """From an at-sign: the name to its left, not before ``since``, and a host of two or more labels to its right."""
    start = at
    while start > since and text[start - 1] in LOCAL:
        start -= 1
    end = LABEL.match(text, at + 1).end()
    if start == at or end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and (after := LABEL.match(text, end + 1).end()) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels > 1 else None


def addresses(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """From the first digit of a chain of numbers joined by dots: each four of them, if valid; and the chain's end."""
    runs = [(at, DIGIT_RUN.match(text, at).end())]
    while text[runs[-1][1] : runs[-1][1] + 1] == "." and text[runs[-1][1] + 1 : runs[-1][1] + 2] in DIGITS:
        a = runs[-1][1] + 1
        runs.append((a, DIGIT_RUN.match(text, a).end()))
    fours = [runs[k : k + 4] for k in range(0, len(runs) - 3, 4)]
    small = lambda a, b: len(text[a:b].lstrip("0")) < 4 and int(text[a:b][-3:]) <= 255
    return [(x[0][0], x[3][1]) for x in fours if all(small(*r) for r in x)], runs[-1][1]


def card(text: str, at: int) -> tuple[bool, int]:
    """From a first digit: whether the digits, at most one blank or hyphen apart, are a card's; and their end."""
    end, digits = at, []
    while True:
        after = DIGIT_RUN.match(text, end).end()
        digits += map(int, text[end:after])
        if text[after : after + 1] in (" ", "-") and text[after + 1 : after + 2] in DIGITS:
            end = after + 1
        else:
            return 14 <= len(digits) <= 19 and luhn(digits), after


def phone(text: str, at: int) -> tuple[bool, int] | None:
    """From a plus sign: whether the number that follows has 10 to 15 digits; and its end."""
    if text[at + 1 : at + 2] not in DIGITS:
        return None
    end = PHONE_RUN.match(text, at + 2).end()
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return 10 <= sum(map(DIGITS.__contains__, text[at:end])) <= 15, end


def url(text: str, at: int, scheme: int, run: list[int]) -> tuple[int, int] | None:
    """``run`` keeps what was read last, so that schemes inside one run of address characters read it once: the run's end,
    the end without closing marks, the end of the host, and where the host's first inner dot or bracket is."""
    start = at + scheme
    if start > run[0]:
        run[0] = end = URL_RUN.match(text, start).end()
        while end > start and text[end - 1] in ".,;:!?)]}":
            end -= 1
        run[1:] = end, -1, -1
    end = max(run[1], start)
    if start > run[2]:
        stop = HOST_END.search(text, start, end)
        run[2] = stop.start() if stop else end
    if start > run[3]:
        inner = HOST_INNER.search(text, start, run[2])
        run[3] = inner.start() if inner else run[2]
    return (at, end) if run[3] < run[2] else None


def account(text: str, at: int, cue: int) -> tuple[int, int] | None:
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    found = ACCOUNT_RUN.match(text, CUE_GAP.match(text, at + cue).end())
    if not found or found.start() == at + cue or not 8 <= found.end() - found.start() <= 128:
        return None
    return found.span() if sum(map(DIGITS.__contains__, found.group())) >= 4 else None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of ``KINDS``."""
    out: list[tuple[str, int, int]] = []
    done, run = dict.fromkeys(KINDS, 0), [-1] * 4
    for last, (kind, length) in automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= done["ip"]:
                found, done["ip"] = addresses(text, at)
                out += [("ip", a, b) for a, b in found]
            if at >= done["card"]:
                good, done["card"] = card(text, at)
                if good:
                    out.append(("card", at, done["card"]))
        elif kind == "email":
            if at >= done["email"] and (span := email(text, at, done["email"])):
                out.append(("email", *span))
                done["email"] = span[1]
        elif kind == "phone":
            if at >= done["phone"] and (number := phone(text, at)):
                done["phone"] = number[1]
                if number[0]:
                    out.append(("phone", at, number[1]))
        elif at >= done[kind] and (span := url(text, at, length, run) if kind == "url" else account(text, at, length)):
            out.append((kind, *span))
            done[kind] = span[1]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind: string, start: long, end: long>>"


def _found_spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in texts:
        found = [spans(t.as_py() or "") for t in batch]
        yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)


def found_spans(text: Column) -> Column:
    return F.arrow_udf(_found_spans, SPANS)(text)


def personal_data(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``spans``: array of (kind, start, end), end exclusive, in code points."""
    return unpacked(docs.select(packed(docs, carry), found_spans(F.col(text_col)).alias("spans")), "spans")


def masked(text: Column, spans_: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, longest one counts."""
    ordered = F.array_sort(spans_, lambda a, b: F.when(a.start != b.start, F.signum(a.start - b.start)).otherwise(F.signum(b.end - a.end)).cast("int"))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(out.alias("out"), s["end"].alias("at")))

    return F.aggregate(ordered, empty, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
