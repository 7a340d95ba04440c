"""Vectorised structural index of JSON texts.

Many documents are laid end to end in one byte buffer. Bitmaps of backslashes, quotes, brackets and delimiters are
built for the whole buffer; a prefix sum of the unescaped quotes tells what lies inside a string, a prefix sum of the
brackets outside strings gives the nesting depth. From the few structural positions follow the spans of all values with
their container, key and position. No document is walked byte by byte.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

_QUOTE, _BACKSLASH, _COMMA, _COLON = b'"\\,:'
_OPEN = np.zeros(256, dtype=np.int8)
_OPEN[[ord("{"), ord("[")]] = 1
_OPEN[[ord("}"), ord("]")]] = -1
_STRUCTURAL = _OPEN != 0
_STRUCTURAL[[_COMMA, _COLON]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\r\n")] = True


@dataclass
class Index:
    """The values of a buffer of documents, in order of their position.

    Of value i: doc its document, box its container (the value that is one; -1 for a root), key_from and key_to the span
    of its key without quotes (key_from -1 in lists and for roots), nth its position in a list or object, start and end
    its span, kind its first byte. good tells for each document whether its structure is sound.
    """

    data: bytes
    bytes_: np.ndarray
    good: np.ndarray
    doc: np.ndarray
    box: np.ndarray
    key_from: np.ndarray
    key_to: np.ndarray
    nth: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray

    def keyed(self, rows: np.ndarray, names: list[str]) -> np.ndarray:
        """The rows whose key is one of names. A key with an escape is decoded before it is compared."""
        hit = np.zeros(len(rows), dtype=bool)
        begin, length = self.key_from[rows], self.key_to[rows] - self.key_from[rows]
        begin = np.where(begin < 0, 0, begin)
        length = np.where(self.key_from[rows] < 0, -1, length)
        for name in names:
            word = np.frombuffer(name.encode(), dtype=np.uint8)
            at = np.flatnonzero(length == len(word))
            if len(at) and len(word):
                at = at[(self.bytes_[begin[at][:, None] + np.arange(len(word))] == word).all(axis=1)]
            hit[at] = True
        for at in np.flatnonzero(self._escaped_keys[rows]):
            hit[at] |= self.key(int(rows[at])) in names
        return rows[hit]

    @property
    def _escaped_keys(self) -> np.ndarray:
        if not hasattr(self, "_escaped"):
            marks = np.cumsum(np.r_[0, self.bytes_ == _BACKSLASH])
            inside = self.key_from >= 0
            self._escaped = np.zeros(len(self.doc), dtype=bool)
            self._escaped[inside] = marks[self.key_to[inside]] > marks[self.key_from[inside]]
        return self._escaped

    def text(self, row: int) -> str:
        """The value's JSON text."""
        return self.data[self.start[row] : self.end[row]].decode("utf-8", "replace")

    def key(self, row: int) -> str:
        raw = self.data[self.key_from[row] : self.key_to[row]]
        text = json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")
        return text.encode("utf-8", "replace").decode()

    def children(self, boxes: np.ndarray) -> np.ndarray:
        """The values directly inside the given containers."""
        wanted = np.zeros(len(self.doc) + 1, dtype=bool)
        wanted[boxes] = True
        wanted[-1] = False  # box -1 of the roots
        return np.flatnonzero(wanted[self.box])

    def within(self, boxes: np.ndarray) -> np.ndarray:
        """A mask of the values at any depth inside the given containers."""
        edge = np.zeros(len(self.bytes_) + 1, dtype=np.int32)
        np.add.at(edge, self.start[boxes] + 1, 1)
        np.add.at(edge, self.end[boxes], -1)
        return np.cumsum(edge)[self.start] > 0


_SCALAR = re.compile(rb"true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


def _whole_strings(quotes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span, given by its first and last byte, is one string from quote to quote."""
    if not len(quotes):
        return np.zeros(len(start), dtype=bool)
    at = np.minimum(np.searchsorted(quotes, start), len(quotes) - 1)
    return (quotes[at] == start) & (at + 1 < len(quotes)) & (quotes[np.minimum(at + 1, len(quotes) - 1)] == end)


def _no_scalars(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the spans that are no JSON scalar. All spans are copied into one buffer of lines, of which each kind is
    looked at once."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    sizes = end - start + 1
    stops = np.cumsum(sizes)
    buffer = raw[np.minimum(np.repeat(start - np.r_[0, stops[:-1]], sizes) + np.arange(stops[-1]), len(raw) - 1)].copy()
    buffer[stops - 1] = 10
    lines = buffer.tobytes().split(b"\n")
    # A line feed inside a span is no part of a scalar; with it, lines and spans would not go together.
    if len(lines) != len(start) + 1:
        return np.flatnonzero([not _SCALAR.fullmatch(raw[s:e].tobytes()) for s, e in zip(start, end)])
    wrong = {line for line in set(lines[:-1]) if not _SCALAR.fullmatch(line)}
    return np.flatnonzero([line in wrong for line in lines[:-1]]) if wrong else np.zeros(0, dtype=np.int64)


def _wrong_escapes(raw: np.ndarray, slash: np.ndarray, fresh: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Positions of backslashes that begin no escape. Backslashes pair up from the start of their run."""
    last = len(raw) - 1
    odd = runs % 2 == 1
    lead = slash[fresh][odd] + runs[odd] - 1
    after = raw[np.minimum(lead + 1, last)]
    wrong = ~_ESCAPED[after]
    coded = after == ord("u")
    for k in range(2, 6):
        wrong |= coded & ~_HEX[raw[np.minimum(lead + k, last)]]
    return lead[wrong]


def index(texts: list[bytes]) -> Index:
    """Structural index of documents, each an object or a list. Those that are no JSON are marked and give no values.

    The check is whole: brackets, commas and colons in their places, keys, strings, escapes, scalars; NaN and the
    infinities count as numbers. Neither the depth nor the length of a document matters.
    """
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, dtype=np.uint8)
    count = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=count)
    begins = np.cumsum(np.r_[0, sizes[:-1] + 1]) if count else np.zeros(0, dtype=np.int64)
    ends = begins + sizes

    # Quotes that no odd run of backslashes escapes. A run cannot cross the line feed between documents.
    quote = raw == _QUOTE
    slash = np.flatnonzero(raw == _BACKSLASH)
    if len(slash):
        fresh = np.flatnonzero(np.r_[True, np.diff(slash) > 1])
        runs = np.diff(np.r_[fresh, len(slash)])
        after = slash[fresh] + runs
        quote[after[(runs % 2 == 1) & (after < len(raw))]] = False
    quotes = np.flatnonzero(quote)
    # Parity counts from each document's own start, so an open string in one does not reach the next.
    first_quote = np.searchsorted(quotes, begins)
    quotes_of = np.searchsorted(quotes, ends) - first_quote
    good = quotes_of % 2 == 0
    ordinal = np.arange(len(quotes)) - np.repeat(first_quote, quotes_of)
    toggles = np.zeros(len(raw) + 1, dtype=np.int8)
    toggles[quotes] = np.where(ordinal % 2 == 0, 1, -1)
    odd = np.flatnonzero(~good)
    toggles[ends[odd]] = -1
    outside = np.cumsum(toggles[:-1], dtype=np.int8) == 0

    at = np.flatnonzero(_STRUCTURAL[raw] & outside)
    sign = raw[at]
    token_doc = np.searchsorted(begins, at, side="right") - 1
    step = _OPEN[sign].astype(np.int64)
    level = np.cumsum(step)
    first_token = np.searchsorted(at, begins)
    last_token = np.searchsorted(at, ends)
    base = np.where(first_token > 0, level[first_token - 1] if len(level) else 0, 0)
    level = level - base[token_doc] if len(at) else level
    depth = level + (step < 0)  # of a bracket: that of its container's inside
    has = last_token > first_token
    good &= has
    if len(at):
        good[has] &= level[last_token[has] - 1] == 0
        low = np.full(count, 1, dtype=np.int64)
        np.minimum.at(low, token_doc, depth)
        good &= low >= 1
        # Nothing but blanks may stand before the root's first bracket or behind its last.
        filled = np.cumsum(np.r_[0, ~_BLANK[raw]])
        first, last = at[np.minimum(first_token, len(at) - 1)], at[np.maximum(last_token - 1, 0)]
        good &= (filled[np.clip(first, begins, ends)] == filled[begins]) & (filled[ends] == filled[np.clip(last + 1, begins, ends)])
        roots = np.bincount(token_doc[(depth == 1) & (step > 0)], minlength=count)
        good &= roots == 1
    keep = good[token_doc] if len(at) else np.zeros(0, dtype=bool)
    at, sign, token_doc, step, depth = at[keep], sign[keep], token_doc[keep], step[keep], depth[keep]

    # In order of (depth, position) a container's bracket, its delimiters and its closing bracket stand together, so the
    # opening bracket of each token is the last one before it there. One sort, whatever the depth.
    opener = np.full(len(at), -1, dtype=np.int64)
    closer = np.full(len(at), -1, dtype=np.int64)
    by_depth = np.argsort(depth, kind="stable")
    last_open = np.maximum.accumulate(np.where(step[by_depth] > 0, np.arange(len(at)), 0)) if len(at) else by_depth
    opener[by_depth] = by_depth[last_open]
    closes = np.flatnonzero(step < 0)
    closer[opener[closes]] = closes
    # Brackets must match in kind: '{' and '}' differ by two, as do '[' and ']'.
    opens = np.flatnonzero(step > 0)
    wrong = sign[closer[opens]] != sign[opens] + 2
    good[np.unique(token_doc[opens[wrong]])] = False

    # Of two neighbouring tokens of a container: colons stand in objects only, behind '{' or a comma, and a comma or '}' of
    # an object has a colon before it.
    is_list = sign == ord("[")
    one, two = by_depth[:-1], by_depth[1:]
    together = opener[one] == opener[two]
    colon_next, in_object = sign[two] == _COLON, ~is_list[opener[two]]
    from_colon, from_open = sign[one] == _COLON, step[one] > 0
    broken = colon_next & (~in_object | from_colon)
    broken |= ~colon_next & in_object & ~from_colon & ~(from_open & (step[two] < 0))
    good[np.unique(token_doc[two[together & broken]])] = False

    # A value begins behind a colon, behind a list's '[' or a comma in a list, and at each root.
    box_token = opener
    in_list = is_list[np.maximum(box_token, 0)]
    starts_value = (sign == _COLON) | (in_list & ((sign == _COMMA) | is_list))
    lead = np.flatnonzero(starts_value)
    filled_at = np.flatnonzero(~_BLANK[raw])

    def next_filled(position: np.ndarray) -> np.ndarray:
        return filled_at[np.minimum(np.searchsorted(filled_at, position), len(filled_at) - 1)] if len(filled_at) else position

    start = next_filled(at[lead] + 1)
    # An empty list has its ']' where a value would start.
    empty = is_list[lead] & (start == at[np.maximum(closer[lead], 0)])
    lead, start = lead[~empty], start[~empty]
    # The value's end: the next delimiter of the same container, found in order of (container, token).
    ending = np.flatnonzero((sign == _COMMA) | (step < 0))
    order = ending[np.argsort(box_token[ending], kind="stable")]
    rank = box_token[order] * (len(at) + 1) + order
    found = np.searchsorted(rank, box_token[lead] * (len(at) + 1) + lead, side="right")
    stop_token = order[np.minimum(found, len(order) - 1)] if len(order) else lead
    stop = at[stop_token] if len(lead) else at[:0]
    # Trailing blanks do not belong to the value.
    end = filled_at[np.searchsorted(filled_at, stop) - 1] + 1 if len(lead) else stop
    good[np.unique(token_doc[lead[end <= start]])] = False
    # An object's bracket has a key or its end behind it, and a colon the whole of one string before it.
    bare = np.flatnonzero((sign == ord("{")) & (sign[np.minimum(np.arange(len(at)) + 1, max(len(at) - 1, 0))] == ord("}")))
    good[np.unique(token_doc[bare[next_filled(at[bare] + 1) != at[np.minimum(bare + 1, max(len(at) - 1, 0))]]])] = False
    colons = np.flatnonzero(sign == _COLON)
    key_end = filled_at[np.searchsorted(filled_at, at[colons]) - 1]
    before = np.empty(len(at), dtype=np.int64)
    before[two] = one
    key_start = next_filled(at[before[colons]] + 1)
    good[np.unique(token_doc[colons[~_whole_strings(quotes, key_start, key_end)]])] = False
    # Values: a string ends at its own closing quote, a container at its own bracket, and anything else is a scalar.
    first = raw[start] if len(start) else raw[:0]
    texts_ = first == _QUOTE
    good[np.unique(token_doc[lead[texts_][~_whole_strings(quotes, start[texts_], end[texts_] - 1)]])] = False
    boxes = _OPEN[first] > 0
    own = np.searchsorted(at, start[boxes])
    good[np.unique(token_doc[lead[boxes][at[closer[own]] + 1 != end[boxes]]])] = False
    plain = ~texts_ & ~boxes & (end > start)
    good[np.unique(token_doc[lead[plain]][_no_scalars(raw, start[plain], end[plain])])] = False
    # Inside strings there are no control characters and only escapes that exist.
    inside = np.flatnonzero((raw < 0x20) & ~outside)
    good[np.searchsorted(begins, inside, side="right") - 1] = False
    if len(slash):
        good[np.searchsorted(begins, _wrong_escapes(raw, slash, fresh, runs), side="right") - 1] = False

    # The key before a colon: the last string that ends before it.
    colon = sign[lead] == _COLON
    inner_quotes = quotes[np.searchsorted(quotes, at[lead]) - 1] if len(quotes) and len(lead) else np.zeros(len(lead), dtype=np.int64)
    open_quotes = quotes[np.maximum(np.searchsorted(quotes, at[lead]) - 2, 0)] if len(quotes) and len(lead) else inner_quotes
    key_from = np.where(colon, open_quotes + 1, -1)
    key_to = np.where(colon, inner_quotes, -1)

    # Roots are values too.
    root = np.flatnonzero((depth == 1) & (step > 0))
    all_start = np.r_[start, at[root]]
    by = np.argsort(all_start, kind="stable")
    value_box_token = np.r_[box_token[lead], np.full(len(root), -1)][by]
    start = all_start[by]
    end = np.r_[end, at[closer[root]] + 1][by]
    key_from, key_to = np.r_[key_from, np.full(len(root), -1)][by], np.r_[key_to, np.full(len(root), -1)][by]
    doc = np.r_[token_doc[lead], token_doc[root]][by]
    # A container's token leads to the value that starts at it.
    value_of = np.full(len(at) + 1, -1, dtype=np.int64)
    place = np.searchsorted(start, at[opens])
    fits = (place < len(start)) & (start[np.minimum(place, max(len(start) - 1, 0))] == at[opens]) if len(start) else np.zeros(len(opens), bool)
    value_of[opens[fits]] = place[fits]
    good[np.unique(token_doc[opens[~fits]])] = False
    box = value_of[value_box_token]
    # Positions: the rank of a value among those of its container.
    grouped = np.argsort(box, kind="stable")
    runs = np.flatnonzero(np.r_[True, np.diff(box[grouped]) != 0]) if len(box) else np.zeros(0, dtype=np.int64)
    nth = np.empty(len(box), dtype=np.int64)
    nth[grouped] = np.arange(len(box)) - np.repeat(runs, np.diff(np.r_[runs, len(box)]))

    sound = good[doc] if len(doc) else np.zeros(0, dtype=bool)
    moved = np.cumsum(np.r_[0, sound]) - 0
    new_box = np.where(box >= 0, moved[np.maximum(box, 0)], -1)
    pick = np.flatnonzero(sound)
    return Index(
        data, raw, good, doc[pick], new_box[pick], key_from[pick], key_to[pick], nth[pick], start[pick], end[pick],
        raw[start[pick]] if len(pick) else np.zeros(0, dtype=np.uint8),
    )


def parsed(text: str):
    """The value of a JSON object or list of any depth, built from its index; ValueError if it is no JSON."""
    ix = index([text.encode("utf-8", "surrogatepass")])
    if not ix.good[0]:
        raise ValueError("no JSON")
    built: list = [None] * len(ix.doc)
    # A container comes before what it holds, so going backwards every value is there when its container asks for it.
    inner: dict[int, list[int]] = {}
    for row in range(len(built) - 1, -1, -1):
        held = inner.pop(row, [])[::-1]
        if ix.kind[row] == ord("{"):
            built[row] = {ix.key(i): built[i] for i in held}
        elif ix.kind[row] == ord("["):
            built[row] = [built[i] for i in held]
        else:
            built[row] = json.loads(ix.text(row))
        inner.setdefault(int(ix.box[row]), []).append(row)
    return built[0]


def loaded(text: str):
    """The JSON value of a text, however deep it is; ValueError if it is no JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        return parsed(text)


def read_document(text: str | None):
    """The JSON value with outer encodings removed, however many; None if null or unreadable."""
    value = text
    try:
        while isinstance(value, str):
            value = loaded(value)
    except ValueError:
        return None
    return value


def written(value) -> str:
    """JSON with sorted keys of a value of any depth."""
    try:
        return json.dumps(value, sort_keys=True, ensure_ascii=False)
    except RecursionError:
        pass
    out, stack = [], [value]
    while stack:
        at = stack.pop()
        if isinstance(at, Raw):
            out.append(at)
        elif isinstance(at, dict):
            parts: list = [Raw("{")]
            for i, key in enumerate(sorted(at)):
                parts += [Raw((", " if i else "") + json.dumps(key, ensure_ascii=False) + ": "), at[key]]
            stack += [*parts, Raw("}")][::-1]
        elif isinstance(at, list):
            parts = [Raw("[")]
            for i, x in enumerate(at):
                parts += [Raw(", "), x] if i else [x]
            stack += [*parts, Raw("]")][::-1]
        else:
            out.append(json.dumps(at, ensure_ascii=False))
    return "".join(out)


class Raw(str):
    """Text that is written as it is."""
