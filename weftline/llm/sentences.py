"""Sentence boundaries across languages and scripts.

Many texts are laid end to end as code points, each with its classes from one table. Two transducers carry the rules. The
first reads characters: abbreviations and the words before numbers are compiled into an automaton, and all words in front
of a full stop are read side by side, a letter a step, so that a word of any length is read whole. What it says of the
word, and the classes of the characters around, tell whether a run of final marks can end a sentence. The second reads
events: final marks, quotation marks and brackets, line breaks, and spaces between Thai letters. It remembers which marks
are open: next state and whether a unit ends, for every state and class. Event sequences are cut into chunks of equal
length, wherever a document begins or ends; every chunk is turned into its state-transition function by stepping all
states through it at once, the functions are composed by a parallel prefix scan, and then every chunk emits from its true
first state. Nothing walks a text or copies a line, so a text without line breaks costs what any other does.

Defined results: null, empty and blank texts have no unit. A line break always ends a unit; every line that is not
blank has at least one, which ends with its last character that is no white space. Repeated documents give repeated
rows. Quotations may be nested to any depth. An opening mark that is not closed in its line is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ------------------------------------------------------------------------------------------------ fixed word lists

#: Abbreviations after which no sentence ends (compared in lower case, without the last full stop).
NEVER = frozenset(
    """
    dr mr mrs ms mx prof rev gen sen rep hon capt col lt sgt st mt messrs vs cf viz al eg ie e.g i.e a.k.a approx est dept
    nos fig figs pp chap vol ed eds
    hr fr hrn frl nr str ca bzw ggf inkl exkl evtl sog vgl z.b u.a d.h s.o s.u i.d.r abb kap bd mio mrd
    p pp m mm mme mlle mgr env p.ex c.-à-d c.à.d av bd
    sr sra srta sres dra d dña avda av c pág págs núm ej aprox p.ej ud uds gral
    проф акад доц г гг стр рис гл ок см ср им ул пл тел т.е напр англ
    κ κα κος αρ σελ π.χ δηλ αγ
    डॉ श्री श्रीमती प्रो पं सुश्री
    د أ م ص ج
    ph
    gov adm supt cmdr brig cpl pvt insp pres amb msgr bldg
    sig sig.ra sig.na dott dott.ssa avv ing pag
    exmo exma ilmo ilma
    dhr mevr mw drs bijv o.a m.b.t
    np tj tzw m.in mgr inż
    bl.a t.ex d.v.s f.eks
    """.split()
)
#: Abbreviations that may be a sentence's last word: it ends there unless a small letter follows.
MAY_END = frozenset(
    """
    a.m p.m u.s u.k e.u u.n u.s.a d.c ph.d b.a m.a inc ltd co corp jr bros etc rd ave blvd
    usw etw o.ä u.ä gmbh
    ee.uu s.a
    пр др т.д т.п руб коп тыс млн млрд
    κ.λπ κτλ δευτ λεπ
    ecc enz itd itp osv
    """.split()
)
#: Abbreviations before a number or a small letter, ordinary words otherwise.
BEFORE_NUMBER = frozenset(
    "no sec art ch jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun s n min max".split()
)
#: German words behind which a number with a full stop is an ordinal.
ORDINAL_LEAD = frozenset("am der die das den dem des im vom zum zur ab seit bis ins jeder jede jedes jeden".split())

# --------------------------------------------------------------------------------------------- classes of characters

_CLASSES = {
    "LEFT": r"[\p{L}\p{M}\p{Nd}.\u00ad\u200b-]", "BLANK": r"\s", "CASELESS": r"[\p{Lo}\p{Lm}]", "HOLDS": r"[\p{Ll}\p{Nd}ºª_/=\\-]", "GREEK": r"\p{Greek}",
    "THAI": r"\p{Thai}", "LETTER": r"\p{L}", "NUMBER": r"\p{Nd}", "BULLET": r"[\s>|*•–-]", "MARK": r"[!?…。！？।॥؟｡．]",
    "HARD": r"[!?。！？।॥؟｡．;\u037e]", "CLOSER": r"[”“\"’»›)）\]】》」』]", "BEHIND": r"[»›”“\"'’)）\]】》」』(（\[【《「『„«‹¿¡]", "QUOTE": r"[(（\[【《「『“„«‹\"”»›」』》】\])）]",
    "CONSONANT": r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZçñćčďłńňřśšťźżžÇÑĆČĎŁŃŇŘŚŠŤŹŻŽ]", "EAST": r"[\p{Han}\p{Hiragana}\p{Katakana}]", "ARABIC": r"\p{Arabic}", "DEVANAGARI": r"\p{Devanagari}", "HEBREW": r"\p{Hebrew}", "HANGUL": r"\p{Hangul}",
}
_METHODS = {"SPACE": str.isspace, "LOWER": str.islower, "UPPER": lambda c: c.isupper() or c.istitle(), "DIGIT": str.isdigit, "ALPHA": str.isalpha}
_FLAG = {name: np.uint32(1 << i) for i, name in enumerate([*_CLASSES, *_METHODS])}
_SCRIPTS = ("EAST", "THAI", "ARABIC", "DEVANAGARI", "HEBREW", "HANGUL")
_PLANE = 1 << 16


def _flags_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class bits and small letters of distinct code points."""
    text = "".join(map(chr, codes.tolist()))
    flags = np.zeros(len(codes), dtype=np.uint32)
    for name, pattern in _CLASSES.items():
        for m in regex.finditer(f"(?:{pattern})+", text, regex.V1):
            flags[m.start() : m.end()] |= _FLAG[name]
    for name, method in _METHODS.items():
        flags[np.fromiter(map(method, text), dtype=bool, count=len(text))] |= _FLAG[name]
    small = np.fromiter((ord(s) if len(s := c.lower()) == 1 else ord(c) for c in text), dtype=np.uint32, count=len(text))
    return flags, small


@lru_cache(maxsize=1)
def _plane() -> tuple[np.ndarray, np.ndarray]:
    return _flags_of(np.arange(_PLANE))


def classified(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class bits and small letters of a text's code points: a table for the first plane, the rest as they occur."""
    flags, small = (table[np.minimum(codes, _PLANE - 1)] for table in _plane())
    far = np.flatnonzero(codes >= _PLANE)
    if len(far):
        distinct, place = np.unique(codes[far], return_inverse=True)
        own = _flags_of(distinct)
        flags[far], small[far] = own[0][place], own[1][place]
    return flags, small


# ------------------------------------------------------------------------------------------ transducer over characters

_KIND = {"may_end": 1, "never": 2, "before_number": 3, "ordinal_lead": 4}


def _compile_words(words: dict[str, frozenset]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of code points of the first plane, next states, and the class of the word that ends in a state. State 0 is
    dead, state 1 the start; symbol 0 stands for every letter that no word has."""
    letters = sorted({c for group in words.values() for w in group for c in w})
    symbols = np.zeros(_PLANE, dtype=np.int16)
    symbols[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    following, kinds = [[0] * (len(letters) + 1) for _ in range(2)], [0, 0]
    for name, group in words.items():
        for word in group:
            at = 1
            for c in word:
                s = symbols[ord(c)]
                if not following[at][s]:
                    following[at][s] = len(following)
                    following.append([0] * (len(letters) + 1))
                    kinds.append(0)
                at = following[at][s]
            kinds[at] = _KIND[name]
    return symbols, np.array(following, dtype=np.int16), np.array(kinds, dtype=np.int8)


_SYMBOLS, _NEXT, _WORD = _compile_words({"ordinal_lead": ORDINAL_LEAD, "before_number": BEFORE_NUMBER, "never": NEVER, "may_end": MAY_END})
_LONGEST = max(map(len, NEVER | MAY_END | BEFORE_NUMBER | ORDINAL_LEAD))


def words_read(small: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Classes of the words between begin and end, 0 for words without one. All words are read side by side, a letter a
    step; a word falls out when no entry goes on like it, so their length does not matter."""
    kinds = np.zeros(len(begin), dtype=np.int8)
    alive = np.flatnonzero(end > begin)
    state = np.ones(len(alive), dtype=np.int16)
    for j in range(_LONGEST + 1):
        done = begin[alive] + j == end[alive]
        kinds[alive[done]] = _WORD[state[done]]
        alive, state = alive[~done], state[~done]
        letter = small[begin[alive] + j]
        state = np.where(letter < _PLANE, _NEXT[state, _SYMBOLS[np.minimum(letter, _PLANE - 1)]], 0)
        alive, state = alive[state > 0], state[state > 0]
        if not len(alive):
            break
    return kinds


# -------------------------------------------------------------------------------------------- transducer over events

LINE, OPEN, LOW, STRAIGHT, STRAIGHT_END, HIGH, HIGH_END, CLOSE, CLOSE_END, END, PAD = range(11)
_DEPTH = 3


def stepped(stack: tuple, event: int) -> tuple:
    """The stack of open marks behind an event: O an opening mark, L a low one, S a straight one."""
    top = stack[-1] if stack else None
    if event == LINE:
        return ()
    if event == OPEN:
        return stack + ("O",)
    if event == LOW:
        return stack + ("L",)
    if event in (STRAIGHT, STRAIGHT_END):
        return stack[:-1] if top == "S" else stack + ("S",)
    if event in (HIGH, HIGH_END):
        return stack[:-1] if top == "L" else stack + ("O",)
    return stack[:-1] if event in (CLOSE, CLOSE_END) else stack


def fires(stack: tuple, event: int) -> bool:
    """Whether a unit ends at an event: outside all marks, or where the outermost one closes."""
    if event == END:
        return not stack
    return event in (STRAIGHT_END, HIGH_END, CLOSE_END) and len(stack) == 1 and not stepped(stack, event)


def _compile(depth: int = _DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The transducer: next state and output for each state (a stack of open marks) and class. The last state is that of
    deeper stacks, which only a line break leaves."""
    stacks = [()]
    for _ in range(depth):
        stacks += [s + (x,) for s in stacks for x in "OLS" if s + (x,) not in stacks]
    number = {s: i for i, s in enumerate(stacks)}
    deep = len(stacks)
    following = np.full((deep + 1, PAD + 1), deep, dtype=np.int16)
    output = np.zeros((deep + 1, PAD + 1), dtype=bool)
    following[deep, LINE] = 0
    for s, i in number.items():
        for c in range(PAD + 1):
            following[i, c] = number.get(stepped(s, c), deep)
            output[i, c] = fires(s, c)
    return following, output, deep


FOLLOWING, OUTPUT, DEEP = _compile()


def transduce(classes: np.ndarray, chunk: int = 64) -> np.ndarray:
    """For each event of a sequence whether a unit ends there.

    Chunks become state-transition functions, a prefix scan composes them, and each chunk runs from its first state. Final
    marks leave every state as it is, so the functions are those of the other events. Lines whose marks nest deeper than
    the transducer's stack are walked again with a stack of their own.
    """
    count = len(classes)
    moving = np.flatnonzero(classes != END)
    rows = -(-len(moving) // chunk)
    grid = np.full(rows * chunk, PAD, dtype=np.int16)
    grid[: len(moving)] = classes[moving]
    grid = grid.reshape(rows, chunk)
    functions = np.broadcast_to(np.arange(len(FOLLOWING), dtype=np.int16), (rows, len(FOLLOWING))).copy()
    for j in range(chunk):
        functions = FOLLOWING[functions, grid[:, j, None]]
    # Hillis-Steele: after step k a row holds the composition of the 2^k chunks that end with it.
    step = 1
    while step < rows:
        functions[step:] = np.take_along_axis(functions[step:], functions[:-step], axis=1)
        step *= 2
    state = np.r_[np.int16(0), functions[:-1, 0]] if rows else np.zeros(0, dtype=np.int16)
    behind = np.zeros((rows, chunk), dtype=np.int16)
    for j in range(chunk):
        state = behind[:, j] = FOLLOWING[state, grid[:, j]]
    # The state before each event is the one behind the last moving event before it.
    behind = np.r_[np.int16(0), behind.reshape(-1)[: len(moving)]]
    before = behind[np.cumsum(classes != END) - (classes != END)]
    out = OUTPUT[before, classes]
    breaks = np.r_[-1, np.flatnonzero(classes == LINE), count]
    for line in np.unique(np.searchsorted(breaks, np.flatnonzero(before == DEEP))):
        stack = ()
        for k in range(breaks[line - 1] + 1, min(breaks[line] + 1, count)):
            out[k] = fires(stack, int(classes[k]))
            stack = stepped(stack, int(classes[k]))
    return out


# --------------------------------------------------------------------------------------------------- events of texts

_URL = regex.compile(
    r"(?i:https?://|www\.)(?:(?![.!?,;:]+(?:\p{Lu}\p{Ll}|\s|$))[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}<>\"“”«»「」（）。！？])+", regex.V1
)
#: Opening marks and what closes them in the same line (fixed values); “ also closes a low mark.
_PAIRS = {"(（": ")）", "[【": "]】", "《": "》", "「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", "‹": "›"}


def _in(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, [ord(c) for c in chars])


class Text:
    """Many texts laid end to end, each with a line break behind it, as code points with their classes."""

    def __init__(self, texts: list[str]):
        self.whole = "".join(t + "\n" for t in texts)
        self.codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.flags, self.small = classified(self.codes)
        self.size = len(self.codes)
        self.ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))) - 1
        feeds = np.flatnonzero(self.codes == 10)
        self.line_begins = np.r_[0, feeds[:-1] + 1] if len(feeds) else feeds
        self.feeds = feeds
        self.filled = np.flatnonzero(~self.has("SPACE"))
        self.quotes = np.flatnonzero(self.has("QUOTE"))

    def has(self, *names: str, at: np.ndarray | None = None) -> np.ndarray:
        """Whether the characters (at positions; beyond the ends, none) are of one of the classes."""
        bits = np.bitwise_or.reduce([_FLAG[n] for n in names])
        if at is None:
            return (self.flags & bits) != 0
        inside = (at >= 0) & (at < self.size)
        return inside & ((self.flags[np.where(inside, at, 0)] & bits) != 0)

    def one_of(self, chars: str, at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < self.size)
        return inside & _in(self.codes[np.where(inside, at, 0)], chars)

    def line_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.feeds, at)

    def behind(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next character of the line that is no white space, or the line's feed; and whether it is not the very next."""
        after = self.filled[np.minimum(np.searchsorted(self.filled, at), len(self.filled) - 1)] if len(self.filled) else np.full(len(at), self.size)
        after = np.where(after < at, self.size, after)
        feed = self.feeds[np.minimum(self.line_of(at), len(self.feeds) - 1)]
        place = np.minimum(after, feed)
        return place, (place > at) | (place == feed)

    def urls(self) -> np.ndarray:
        """A mask of the characters of URLs."""
        mask = np.zeros(self.size, dtype=bool)
        s = self.small
        if self.size > 4:
            slashes = np.flatnonzero((s[:-3] == ord("h")) & (s[1:-2] == ord("t")) & (s[2:-1] == ord("t")) & (s[3:] == ord("p")))
            bare = np.flatnonzero((s[:-3] == ord("w")) & (s[1:-2] == ord("w")) & (s[2:-1] == ord("w")) & (s[3:] == ord(".")))
            last = 0
            for at in np.sort(np.r_[slashes, bare]).tolist():
                if at >= last and (m := _URL.match(self.whole, at)):
                    last = m.end()
                    mask[at:last] = True
        return mask

    def next_in_line(self, chars: str, at: np.ndarray) -> np.ndarray:
        """Whether one of chars stands at or behind a position in its line."""
        found = self.quotes[_in(self.codes[self.quotes], chars)]
        if not len(found):
            return np.zeros(len(at), dtype=bool)
        place = np.searchsorted(found, at)
        near = found[np.minimum(place, len(found) - 1)]
        return (place < len(found)) & (near < self.feeds[self.line_of(at)])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def marks_of(t: Text, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of final marks outside URLs."""
    after = np.r_[t.has("HOLDS")[1:], False]
    before = np.r_[False, t.has("GREEK")[:-1]]
    dot = (t.codes == ord(".")) & ~after
    question = ((t.codes == ord(";")) | (t.codes == 0x37E)) & before
    return _runs((dot | t.has("MARK") | question) & free)


def marks_end(t: Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each run of marks can end a sentence, from what is left and right of it."""
    place, spaced = t.behind(end)
    line = t.codes[np.minimum(place, t.size - 1)] == 10
    small, capital = t.has("LOWER", at=place) & ~line, t.has("UPPER", at=place) & ~line
    digit = t.has("DIGIT", at=place) & ~(line | small | capital)
    caseless = t.has("CASELESS", at=place) & ~(line | small | capital | digit)
    other = ~(line | small | capital | digit | caseless)
    hard = np.cumsum(np.r_[0, t.has("HARD")])
    hard = hard[end] > hard[start]
    # Small letters right behind a question or exclamation mark that stands behind a digit belong to a name or address.
    plain = t.one_of("?!.", end - 1) & t.has("DIGIT", at=start - 1)
    ends = np.where(hard, spaced | ~small | ~plain, False)
    dots = ~hard & ((end - start > 1) | t.one_of("…", start))
    ends = np.where(dots, ~small & (spaced | ~digit) & ~t.one_of(".", end), ends)
    lone = np.flatnonzero(~hard & ~dots)
    ends[lone] = _full_stops_end(t, start[lone], *(x[lone] for x in (spaced, line, small, capital, digit, other)))
    return ends


def _full_stops_end(t: Text, start, spaced, line, small, capital, digit, other) -> np.ndarray:
    """marks_end of lone full stops; the rules in order, of which the first that applies holds."""
    begin_line = t.line_begins[t.line_of(start)]
    outside = np.flatnonzero(~t.has("LEFT"))
    if not len(outside):
        outside = np.array([t.size])
    reach = np.searchsorted(outside, start)
    word = np.where(reach > 0, outside[np.maximum(reach - 1, 0)] + 1, 0)
    # Hyphens at either end are no part of the word.
    dash = t.codes == ord("-")
    solid = np.flatnonzero(~dash)
    stop = solid[np.maximum(np.searchsorted(solid, start) - 1, 0)] + 1
    stop = np.where(np.searchsorted(solid, start) > 0, stop, 0)
    word = np.minimum(solid[np.minimum(np.searchsorted(solid, word), len(solid) - 1)], start)
    stop = np.maximum(np.minimum(stop, start), word)
    length = stop - word
    dashes = np.flatnonzero(dash)
    cut = np.searchsorted(dashes, stop)
    part = np.where(cut > 0, dashes[np.maximum(cut - 1, 0)] + 1, 0) if len(dashes) else word
    part = np.maximum(part, word)
    kind = words_read(t.small, word, stop)
    may_end = (kind == _KIND["may_end"]) | (words_read(t.small, part, stop) == _KIND["may_end"])

    # A list number: nothing but bullets and quote marks, a bracket perhaps, and up to three digits or a letter before it.
    bullet = t.has("BULLET")
    quoted = np.flatnonzero((t.codes[:-3] == ord("&")) & (t.codes[1:-2] == ord("g")) & (t.codes[2:-1] == ord("t")) & (t.codes[3:] == ord(";"))) if t.size > 4 else dashes[:0]
    for k in range(4):
        bullet[quoted + k] = True
    text_at = np.flatnonzero(~bullet)
    lead = text_at[np.minimum(np.searchsorted(text_at, begin_line), len(text_at) - 1)] if len(text_at) else start
    lead = lead + (t.one_of("(", lead) & (lead < start))
    span = start - lead
    numbers = np.cumsum(np.r_[0, t.has("NUMBER")])
    ascii_letter = t.has("LETTER", at=lead) & (t.codes[np.minimum(lead, t.size - 1)] < 128)
    listed = ((span >= 1) & (span <= 3) & (numbers[start] - numbers[np.minimum(lead, start)] == span)) | ((span == 1) & ascii_letter)

    one, two, three = start - 1, start - 2, start - 3
    in_line = lambda at: at >= begin_line
    single = length == 1
    # A unit or a year's mark behind a number.
    figure = (in_line(two) & t.has("DIGIT", at=two)) | (in_line(three) & t.has("SPACE", at=two) & t.has("DIGIT", at=three))
    unit = single & t.has("LOWER", at=one) & figure
    initial = single & t.has("ALPHA", at=word) & ~t.has("CASELESS", at=word)
    # The last letter of two that are abbreviated one by one, as in "т. д.", may end a sentence.
    back = np.where(t.has("SPACE", at=two), three, two)
    chained = (t.one_of(".", back) & t.one_of("тТ", back - 1) & t.one_of("дпДП", word)) & in_line(back - 1) & ~(in_line(start - 4) & (back == two) & t.has("LEFT", at=start - 4))

    digits = (length > 0) & (length <= 2) & (numbers[stop] - numbers[word] == length)
    blank = t.has("BLANK") & (t.codes != 10) & (t.codes != 13)
    gap_begin = np.flatnonzero(~blank)
    near = np.searchsorted(gap_begin, word)
    lead_stop = np.where(near > 0, gap_begin[np.maximum(near - 1, 0)] + 1, 0)
    no_letter = np.flatnonzero(~t.has("LETTER"))
    far = np.searchsorted(no_letter, lead_stop)
    lead_begin = np.where(far > 0, no_letter[np.maximum(far - 1, 0)] + 1, 0)
    ordinal = digits & (capital | small) & (lead_stop < word)
    picked = np.flatnonzero(ordinal)
    ordinal[picked] = words_read(t.small, lead_begin[picked], lead_stop[picked]) == _KIND["ordinal_lead"]

    vowelless = _abbreviated(t, word, stop)
    rules = [
        (~spaced & other & ~t.has("BEHIND", at=start + 1), False),
        (listed & ~line, False),
        (length == 0, True),
        (may_end, ~small),
        (unit, ~small),
        (kind == _KIND["never"], False),
        (kind == _KIND["before_number"], spaced & ~digit & ~small),
        (initial, chained & ~small),
        (vowelless, False),
        (ordinal, False),
        (small & t.has("DIGIT", at=stop - 1), False),
        (~spaced & capital, length > 1),
    ]
    return np.select([r for r, _ in rules], [np.broadcast_to(x, len(start)) for _, x in rules], True)


def _abbreviated(t: Text, word: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words of two to five Latin letters, a capital and then small ones, without a vowel or a doubled last letter (Hmm)."""
    found = (stop - word >= 2) & (stop - word <= 5) & t.has("UPPER", at=word)
    at = np.flatnonzero(found)
    consonants, capitals = (np.cumsum(np.r_[0, t.has(name)]) for name in ("CONSONANT", "UPPER"))
    size, last = (stop - word)[at], stop[at] - 1
    all_ = consonants[stop[at]] - consonants[word[at]] == size
    found[at] = all_ & (capitals[stop[at]] - capitals[word[at]] == 1) & (t.small[last] != t.small[last - 1])
    return found


def quotes_of(t: Text, free: np.ndarray, mark_start: np.ndarray, mark_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and classes of the quotation marks and brackets that count, beside the marks that can end a sentence."""
    at = t.quotes[free[t.quotes]]
    line, code = t.line_of(at), t.codes[at]
    is_ = lambda chars: _in(code, chars)
    straight = t.quotes[t.codes[t.quotes] == ord('"')]
    even = np.bincount(t.line_of(straight), minlength=len(t.feeds)) % 2 == 0
    skip = is_('"') & ~even[line]
    low = t.quotes[t.codes[t.quotes] == ord("„")]
    lows = np.searchsorted(low, at) > np.searchsorted(low, t.line_begins[line])
    for opening, closing in _PAIRS.items():
        some = np.flatnonzero(is_(opening))
        closed = t.next_in_line(closing, at[some] + 1)
        skip[some] = ~(closed | lows[some]) if opening == "“" else ~closed
    skip |= is_("(") & t.one_of(":;", at - 1) & (at > t.line_begins[line])
    skip |= is_(")") & t.one_of(":;-", at - 1) & t.has("SPACE", at=at - 2)
    at, code = at[~skip], code[~skip]

    # Closing marks right behind a final mark, one behind the other; « French » ones may have a space before them.
    wide = t.has("BLANK", at=mark_end) & ~t.one_of("\r\n", mark_end)
    closed = t.has("CLOSER", at=mark_end) | t.one_of("'", mark_end) | (wide & t.one_of("»›", mark_end + 1))
    heads, head_ends = mark_start[closed], mark_end[closed]
    place = np.r_[head_ends - 1, at]
    order = np.argsort(place, kind="stable")
    place, is_head = place[order], order < len(heads)
    previous = np.r_[-9, place[:-1]]
    gap = place - previous - 1
    guillemet = _in(t.codes[place], "»›")
    joined = ~is_head & ((gap == 0) | ((gap == 1) & guillemet & t.has("SPACE", at=place - 1)))
    run = np.cumsum(~joined)
    run_head = np.flatnonzero(~joined)[run - 1] if len(place) else place
    adjacent = joined & is_head[run_head] if len(place) else joined
    # The letter before the final mark, whose script tells whether a clause goes on.
    content = np.full(len(place), -1, dtype=np.int64)
    first = heads - 1
    first = np.where(t.has("SPACE", at=first), first - 1, first)
    content[is_head] = first[order[is_head]]
    content = content[run_head] if len(place) else content
    adjacent, content = adjacent[~is_head], content[~is_head]

    end = at + 1
    after, _ = t.behind(end)
    line_ends = t.codes[np.minimum(after, t.size - 1)] == 10
    small = t.has("LOWER", at=after) & ~line_ends
    cased = small | t.has("UPPER", "DIGIT", at=after) | line_ends
    caseless = t.has("CASELESS", at=after) & ~cased
    same = np.zeros(len(at), dtype=bool)
    for name in _SCRIPTS:
        same |= t.has(name, at=content) & t.has(name, at=after)
    may = adjacent & ~small & ~(caseless & ~_in(code, ")）]】") & same)
    is_ = lambda chars: _in(code, chars)
    classes = np.select(
        [is_('"'), is_("“"), is_("„"), is_("(（[【《「『«‹")],
        [np.where(may, STRAIGHT_END, STRAIGHT), np.where(may, HIGH_END, HIGH), LOW, OPEN], np.where(may, CLOSE_END, CLOSE),
    )
    return end, classes


def units_of(t: Text) -> np.ndarray:
    """Ends of all units, in order."""
    free = ~t.urls()
    start, end = marks_of(t, free)
    can = marks_end(t, start, end)
    start, end = start[can], end[can]
    quote_ends, quote_classes = quotes_of(t, free, start, end)
    blank = t.has("BLANK") & (t.codes != 10) & (t.codes != 13) & free
    thai, thai_end = _runs(blank)
    between = t.has("THAI", at=thai - 1) & t.has("THAI", at=thai_end)
    thai = thai[between]

    # Events in the order in which they begin; ends tell where a unit ends if it does.
    begins = np.r_[t.feeds, start, quote_ends - 1, thai]
    ends = np.r_[t.feeds, end, quote_ends, thai]
    classes = np.r_[np.full(len(t.feeds), LINE), np.full(len(start), END), quote_classes, np.full(len(thai), END)].astype(np.int16)
    order = np.argsort(begins, kind="stable")
    ends, classes = ends[order], classes[order]
    cuts = ends[transduce(classes)]

    # Of two ends in a line with nothing but closing marks and white space between them, the later one holds.
    solid = np.cumsum(np.r_[0, ~t.has("SPACE", "CLOSER")])
    line = t.line_of(cuts - 1)
    last = np.r_[line[1:] != line[:-1], True] if len(cuts) else np.zeros(0, dtype=bool)
    kept = last | (solid[np.r_[cuts[1:], 0]] > solid[cuts]) if len(cuts) else last
    # What is left in a line behind its last end is a unit too.
    tail_from = t.line_begins.copy()
    tail_from[line[last]] = cuts[last]
    reach = np.searchsorted(t.filled, t.feeds)
    final = np.where(reach > 0, t.filled[np.maximum(reach - 1, 0)] + 1, 0) if len(t.filled) else np.zeros(len(t.feeds), dtype=np.int64)
    return np.sort(np.r_[cuts[kept], final[final > tail_from]])


CHUNK_CHARS = 1 << 20


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, str]]:
    """(text's number, start, piece): texts, the long ones parted at line breaks, across which no rule looks."""
    for number, text in enumerate(texts):
        start = 0
        while text and len(text) - start > CHUNK_CHARS:
            cut = text.rfind("\n", start, start + CHUNK_CHARS)
            cut = text.find("\n", start + CHUNK_CHARS) if cut < 0 else cut
            if cut < 0:
                break
            yield number, start, text[start:cut]
            start = cut + 1
        yield number, start, (text or "")[start:]


def _chunks(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    held, size = [], 0
    for piece in _pieces(texts):
        if held and size + len(piece[2]) > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2]) + 1
    if held:
        yield held


def unit_ends(texts: list[str | None]) -> list[list[int]]:
    """Ends of the sentence units of each text, in code points."""
    counts, ends = units(texts)
    return [part.tolist() for part in np.split(ends, np.cumsum(counts)[:-1])] if len(counts) else []


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The number of units of each text, and the ends of all of them."""
    counts, ends = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
    for chunk in _chunks(texts):
        numbers, starts = np.array([p[0] for p in chunk]), np.array([p[1] for p in chunk])
        t = Text([p[2] for p in chunk])
        cuts = units_of(t)
        piece = np.searchsorted(t.ends, cuts - 1)
        np.add.at(counts, numbers[piece], 1)
        ends.append(cuts - np.r_[0, t.ends[:-1] + 1][piece] + starts[piece])
    return counts, np.concatenate(ends)


def sentence_units(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, end_char): one row per sentence unit."""
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, ends = units(batch["text"].tolist())
            if len(ends):
                yield pd.DataFrame({"id": batch["id"].repeat(counts).reset_index(drop=True), "end_char": ends})

    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(run, f"id {kind}, end_char BIGINT").withColumnRenamed("id", id_column)
