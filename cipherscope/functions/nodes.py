"""Brackets and calls of source text as a table of nodes, built in arrays over many files at once.

Files of one language lie one after another, a NUL byte between them, comments blanked and literals filled with MARK. Every
bracket is a node numbered in pre-order by its place, with the place where it closes (post-order), so what encloses what is
an interval; parents are its links. Call heads, commas and literals refer to nodes. No rule looks at a fixed number of
characters: what stands before or after a place is found by sorted positions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property

import numpy as np

from .lexing import COMMENT, STRING, literals

MARK = b"\x01"
_MARK = MARK[0]
_ID = rb"[A-Za-z_$][\w$]*"
_BEFORE = rb"(?<![\w$])"
_DOT = rb"\s*(?:\.|::|->|\?\.)\s*"
_ANGLES = rb"<(?:[\w\s.,:?&\[\]*']|<(?:[\w\s.,:?&\[\]*']|<[\w\s.,:?&\[\]*']*>)*>)*>"
_TURBOFISH = rb"::<(?:[^()<>;{}]|<(?:[^()<>;{}]|<[^()<>;{}]*>)*>|\([^()]*\))*>"
_PATH = _BEFORE + rb"(new\s+)?(" + _ID + rb"(?:" + _DOT + _ID + rb")*)"
_HEADS = {
    "rust": re.compile(_BEFORE + rb"()(" + _ID + rb"(?:(?:\s*(?:\.|::)\s*|" + _TURBOFISH + rb"::)" + _ID + rb")*!?)(" + _TURBOFISH + rb")?\s*\("),
    "java": re.compile(_PATH + rb"(" + _ANGLES + rb")?\s*\("),
    "go": re.compile(_PATH + rb"(\[[\w\s.,*\[\]]*\])?\("),
    "python": re.compile(_PATH + rb"()[ \t]*\("),
    "c": re.compile(_PATH + rb"()\s*\("),
}
_HEADS |= {"csharp": _HEADS["java"], "typescript": _HEADS["java"], "cpp": _HEADS["java"], "javascript": _HEADS["c"]}
#: Words before a bracket that call nothing, in most languages and in each.
_CONTROL = set(b"if for while switch return catch else case throw do try".split())
KEYWORDS = {
    "python": set(b"if elif while for return and or not in is lambda def class with assert except raise del yield await case match import from async".split()),
    "go": set(b"if for switch select return func case go defer range var const type import interface struct map chan".split()),
    "rust": set(b"if while for match return fn let in mut pub where impl dyn move unsafe loop ref as use crate".split()),
    "c": _CONTROL | set(b"sizeof alignof _Alignof typeof __attribute__ defined _Static_assert".split()),
    "cpp": _CONTROL | set(b"sizeof alignof decltype noexcept static_assert __attribute__ defined new delete throw co_await co_return co_yield".split()),
    "java": _CONTROL | set(b"synchronized assert new instanceof yield".split()),
    "csharp": _CONTROL | set(b"foreach lock using fixed checked unchecked nameof typeof sizeof default when await in is as out ref stackalloc new".split()),
    "javascript": _CONTROL | set(b"function typeof await yield of in instanceof delete void new import with".split()),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]
#: Words right before a name that say that it is declared, or stands in a pattern.
_DECLARING = {"python": (b"def", b"class", b"case"), "go": (b"func",), "rust": (b"fn", b"struct", b"union", b"let")}
#: Words of an expression or statement; a name right after one is called, not declared.
_SPEAKING = {b"return", b"throw", b"new", b"else", b"do", b"case", b"await", b"yield", b"in", b"not", b"and", b"or", b"if", b"while", b"goto", b"co_await", b"co_return", b"co_yield", b"typeof", b"instanceof", b"of", b"assert", b"delete", b"is", b"as", b"out", b"ref", b"when", b"switch", b"from", b"select", b"default", b"lock", b"using", b"defer", b"go", b"sizeof", b"try", b"finally"}
_TYPE_LIKE = re.compile(rb"[^=;()+\-/%!?|^\[\]\"'.]*(?:\.[\w$]+[^=;()+\-/%!?|^\"'.]*|\[\s*\][^=;()+\-/%!?|^\"'.]*)*\Z")
_LAST_WORD = re.compile(rb"([\w$]+)\s*\Z")
_AFTER = re.compile(rb"\s*(\{|;|throws\b|const\b|noexcept\b|override\b|final\b|where\b|=>|:(?!:)|=\s*(?:0|default|delete)\b|->)")
_MODIFIERS = re.compile(rb"\s*(?:(?:async|static|get|set|public|private|protected|readonly|override|abstract|declare|export|default)\b\s*|[*#]\s*)*\Z")
_DEFINES = re.compile(rb"#\s*define\s+\Z")
#: What joins the names of a path, and what a path holds beside names where it is not written tightly.
_JOINT, _SPACED = re.compile(rb"\s*(\.|::|->|\?\.)\s*"), re.compile(rb"[ \t\n?]")
_LIST = re.compile(rb"\bmap\[[^{}]*\Z")
_DECLARED = re.compile(rb"(?:\b(?:const|var|let|final|static)\b[^;{}()]*|(?:\A|\n)\s*[\w.<>\[\]]+\s+\w+\s*)\Z")

OPEN, CLOSE = b"([{", b")]}"


class Source:
    """The nodes of some files of one language."""

    def __init__(self, texts: list[bytes], lang: str):
        self.lang, self.raw = lang, b"\0".join(texts) + b"\0"
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.file_at = np.cumsum(sizes + 1) - sizes - 1
        spans: list[tuple] = []
        for at, text in zip(self.file_at.tolist(), texts):
            spans += [(a + at, b + at, k, c + at, d + at) for a, b, k, c, d in literals(text, lang)]
        spans = np.array(spans, np.int64).reshape(-1, 5)
        self.raw_array = np.frombuffer(self.raw, np.uint8)
        fill = np.zeros(len(self.raw) + 1, np.int8)
        for kind in (COMMENT, STRING):
            own = spans[spans[:, 2] == COMMENT] if kind == COMMENT else spans[spans[:, 2] != COMMENT]
            np.add.at(fill, own[:, 0], 1 + kind)
            np.add.at(fill, own[:, 1], -1 - kind)
        fill = np.cumsum(fill[:-1])
        code = self.raw_array.copy()
        code[fill == 1] = 32
        code[fill == 2] = _MARK
        self.array = code
        self.code = code.tobytes()
        self.strings = spans[spans[:, 2] == STRING]
        self._brackets()

    def __getattr__(self, name: str):
        """What call heads say is found when it is first asked for."""
        if name in ("start", "callee", "generic", "node", "head", "called", "kind"):
            self._heads()
            return self.__dict__[name]
        raise AttributeError(name)

    # Places

    @cached_property
    def shown(self) -> np.ndarray:
        """Places that are not blank."""
        c = self.array
        return np.flatnonzero((c != 32) & ((c < 9) | (c > 13)))

    @cached_property
    def _not_word(self) -> np.ndarray:
        return np.flatnonzero(~_WORD[self.array])

    def places(self, name: str) -> np.ndarray:
        """Places of characters outside a class: word, digit, path (dotted names), callee (what may lead to a call)."""
        if name not in self._outside:
            self._outside[name] = np.flatnonzero(~_CLASSES[name][self.array])
        return self._outside[name]

    @cached_property
    def _outside(self) -> dict[str, np.ndarray]:
        return {}

    @cached_property
    def newlines(self) -> np.ndarray:
        return np.flatnonzero(self.raw_array == 10)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The last place before ``at`` that is not blank; -1 if there is none."""
        k = np.searchsorted(self.shown, at) - 1
        return np.where(k >= 0, self.shown[np.maximum(k, 0)], -1)

    def after(self, at: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on that is not blank (the last byte is a NUL)."""
        return self.shown[np.minimum(np.searchsorted(self.shown, at), len(self.shown) - 1)]

    def char(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.array[np.maximum(at, 0)], 0)

    def file_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.file_at, at, side="right") - 1

    def line_of(self, at: np.ndarray) -> np.ndarray:
        first = self.file_at[self.file_of(at)]
        return np.searchsorted(self.newlines, at) - np.searchsorted(self.newlines, first) + 1

    @cached_property
    def _characters(self) -> np.ndarray:
        return np.append(0, np.cumsum((self.raw_array & 0xC0) != 0x80))

    def offset_of(self, at: np.ndarray) -> np.ndarray:
        """Characters before ``at`` in its file."""
        return self._characters[at] - self._characters[self.file_at[self.file_of(at)]]

    # Nodes

    def _brackets(self) -> None:
        """Every closing bracket closes the last one open; what is open at a file's end closes there. A bracket's level is
        one more than its parent's, so in the order of levels an opening one is followed by the one that closes it."""
        at = np.flatnonzero(_TOKEN[self.array])
        kind = self.array[at]
        comma, border = kind == 44, kind == 0
        step = _table(OPEN)[kind].astype(np.int64) - _table(CLOSE)[kind]
        file = np.cumsum(border) - border
        total = np.cumsum(step)
        total -= np.append(0, total[border])[file]
        # Closing brackets that close nothing bring a file's total to a new low.
        apart = file * (2 * len(at) + 2)
        low = np.minimum(np.minimum.accumulate(total - apart) + apart, 0)
        depth = total - low
        stray = (step < 0) & (low < np.append(0, np.where(border, 0, low))[:-1])
        opens = np.flatnonzero(step > 0)
        self.open, level = at[opens], depth[opens]
        # Levels, and places in them: an open bracket's next of the same level and file closes it.
        both = np.flatnonzero((step > 0) | (step < 0) & ~stray)
        order = np.lexsort((both, depth[both] + (step[both] < 0)))
        both = both[order]
        near = np.append(both[1:], 0)
        closed = np.append((step[both[1:]] < 0) & (file[both[1:]] == file[both[:-1]]), False)[: len(both)]
        ends = at[border]
        close = np.where(closed, at[near], ends[file[both]]) if len(both) else both
        self.close = np.zeros(len(at), np.int64)
        self.close[both] = close
        self.close = self.close[opens]
        by_level = np.lexsort((self.open, level))
        wide = len(self.array)
        keys = (level * wide + self.open)[by_level]

        def holder(levels: np.ndarray, places: np.ndarray) -> np.ndarray:
            """The last bracket of these levels before these places; -1 at level 0."""
            if not len(keys):
                return np.full(len(levels), -1)
            return np.where(levels > 0, by_level[np.searchsorted(keys, levels * wide + places) - 1], -1)

        self.parent = holder(level - 1, self.open)
        self.comma_at = at[comma]
        self.comma_in = holder(depth[comma], self.comma_at)
        #: Statements begin after these.
        self.ends = np.flatnonzero(_BOUNDARY[self.array])

    @cached_property
    def _ends(self) -> list[int]:
        return self.ends.tolist()

    def statement(self, at: int) -> int:
        """Where the part of the statement before ``at`` begins: after the last of ``( ) { } [ ] ;`` or the file's border."""
        k = bisect_left(self._ends, at) - 1
        return self._ends[k] + 1 if k >= 0 else 0

    def statement_of_import(self, at: int) -> int:
        """Where the import that a literal may stand in begins: its own line, or the bracket it stands in."""
        k = int(np.searchsorted(self.open, at)) - 1
        while k >= 0 and self.close[k] < at:
            k = int(self.parent[k])
        begin = int(self.open[k]) if k >= 0 and self.array[self.open[k]] == 40 else at
        return max(self.code.rfind(b"\n", 0, begin), self.code.rfind(b"\0", 0, begin)) + 1

    def _heads(self) -> None:
        """Call heads: start, the bracket they open, callee, type arguments."""
        words = KEYWORDS.get(self.lang, _CONTROL)
        rows = [(start, open_, b"new " + name if new else name, generic) for start, open_, new, name, generic in self._named_brackets() if new or name not in words]
        starts, opens, names, generics = map(list, zip(*rows)) if rows else ([], [], [], [])
        self.start, self.callee, self.generic = np.array(starts, np.int64), names, generics
        node = np.searchsorted(self.open, opens) if len(opens) else np.zeros(0, np.int64)
        #: The head of each node, or -1.
        self.head = np.full(len(self.open), -1)
        self.head[node] = np.arange(len(node))
        self.node = node
        self.callee = [_JOINT.sub(lambda m: m[1].lstrip(b"?"), n) if _SPACED.search(n) else n for n in names] if _SPACED.search(b".".join(names)) else names
        if self.lang == "rust":
            for i, n in enumerate(self.callee):
                if b"<" in n:
                    self.generic[i] = self.generic[i] or re.search(_TURBOFISH, n)[0]
                    self.callee[i] = re.sub(_TURBOFISH, b"", n)
        self.called = self._called()
        self.kind = self._kinds()

    def _named_brackets(self) -> list[tuple]:
        """(start, round bracket, whether constructed, name, type arguments) of round brackets behind a dotted name, in order.
        Names right before a bracket are followed to the left in arrays; the language's pattern reads the rest."""
        pattern, code, c = _HEADS.get(self.lang, _HEADS["java"]), self.code, self.array
        if self.lang == "rust":
            return [(m.start(), m.end() - 1, False, m[2], m[3]) for m in pattern.finditer(code)]
        at = self.open[c[self.open] == 40] if len(self.open) else self.open
        last = self.before(at)
        if self.lang == "go":
            near = last == at - 1
        elif self.lang == "python":
            breaks = np.flatnonzero((c > 9) & (c < 14))
            near = np.searchsorted(breaks, at) == np.searchsorted(breaks, last)
        else:
            near = np.ones(len(at), bool)
        near &= last >= 0
        at, last = at[near], last[near]
        named = _ID_PART[c[last]] if len(last) else np.zeros(0, bool)
        closing = (c[last] == 93) if self.lang == "go" else (c[last] == 62) & (pattern is _HEADS["java"])
        found = []
        for open_, end in zip(at[closing].tolist(), last[closing].tolist()):
            k = bisect_left(self._not_generic, end) - 1
            for m in pattern.finditer(code, self._not_generic[k] + 1 if k >= 0 else 0, open_ + 1):
                if m.end() == open_ + 1:
                    found.append((m.start(), open_, bool(m[1]), m[2], m[3]))
        at, last = at[named], last[named]
        outside = np.flatnonzero(~_ID_PART[c])

        def word(end: np.ndarray) -> np.ndarray:
            """Where the word that ends there begins."""
            k = np.searchsorted(outside, end) - 1
            return np.where(k >= 0, outside[np.maximum(k, 0)], -1) + 1

        start = word(last)
        good = ~_DIGIT[c[start]] if len(start) else np.zeros(0, bool)
        at, last, start = at[good], last[good], start[good]
        going = np.arange(len(at))
        while len(going):
            sign = self.before(start[going])
            x, y = self.char(sign), self.char(sign - 1)
            sign = np.where((x == 46) & (y != 63), sign, sign - 1)
            linked = (x == 46) | (x == 58) & (y == 58) | (x == 62) & (y == 45)
            end = self.before(sign)
            linked &= (end >= 0) & _ID_PART[self.char(end)]
            going, begin = going[linked], word(end[linked])
            on = ~_DIGIT[c[begin]] if len(begin) else np.zeros(0, bool)
            going = going[on]
            start[going] = begin[on]
        whole = start.copy()
        before = self.before(start)
        new = (before < start - 1) & self._whole_word(before, b"new")
        whole[new] = before[new] - 2
        found += [(w, o, n, code[s : e + 1], b"") for w, o, n, s, e in zip(whole.tolist(), at.tolist(), new.tolist(), start.tolist(), last.tolist())]
        return sorted(found, key=lambda row: row[1]) if closing.any() else found

    @cached_property
    def _not_generic(self) -> list[int]:
        return np.flatnonzero(~_GENERIC[self.array]).tolist()

    def _whole_word(self, at: np.ndarray, word: bytes) -> np.ndarray:
        """As ``_word_ends``, but a dot may stand before the word."""
        c, found = self.array, at >= len(word) - 1
        for k, x in enumerate(reversed(word)):
            found = found & (c[np.maximum(at - k, 0)] == x)
        return found & ~(_ID_PART[c[np.maximum(at - len(word), 0)]] & (at >= len(word)))

    def _called(self) -> np.ndarray:
        """False for heads of declarations, patterns, macros and annotations."""
        called = np.ones(len(self.start), bool)
        if not len(self.start):
            return called
        before, after = self.before(self.start), self.after(self.close[self.node] + 1)
        b, a = self.char(before), self.char(after)
        if self.lang in _DECLARING:
            near = (b == 41) if self.lang == "go" else (a == 61) if self.lang == "rust" else np.zeros(len(b), bool)
            for word in _DECLARING[self.lang]:
                called &= ~self._word_ends(before, word)
        else:  # a name, a closing angle, star or the like before, or a body, a type, a clause after: look closer
            near = (_NAMED[b] & ~self._word_ends(before, b"return")) | (a == 123) | (a == 58) | (b == 64)
            near |= (a == 61) & (self.lang == "cpp")
        bodies = self._bodies.get(self.lang)
        if bodies:
            near |= np.isin(self.parent[self.node], self._opened_by(bodies))
        for i in np.flatnonzero(near & called).tolist():
            called[i] = not self._declared(i, int(before[i]), int(b[i]))
        if self.lang == "rust":
            called &= ~np.array([n.endswith(b"!") for n in self.callee], bool)
        return called

    def _word_ends(self, at: np.ndarray, word: bytes) -> np.ndarray:
        """Whether a word ends at each place."""
        c, found = self.array, at >= len(word) - 1
        for k, x in enumerate(reversed(word)):
            found = found & (c[np.maximum(at - k, 0)] == x)
        return found & ~(_WORD[c[np.maximum(at - len(word), 0)]] & (at >= len(word)))

    def _word_before(self, at: int) -> bytes:
        m = _LAST_WORD.search(self.code, self.statement(at), at)
        return m[1] if m else b""

    #: Bodies that declare by the shape of a call.
    _bodies = {"go": re.compile(rb"\binterface\s*\{"), "rust": re.compile(rb"\benum\s+\w[^{};]*\{")}

    def _opened_by(self, pattern: re.Pattern) -> np.ndarray:
        """Nodes of the braces that matches of the pattern end with."""
        return np.searchsorted(self.open, [m.end() - 1 for m in pattern.finditer(self.code)])

    @cached_property
    def _declaring_bodies(self) -> set[int]:
        return set(self._opened_by(self._bodies[self.lang]).tolist())

    def _declared(self, i: int, before: int, b: int) -> bool:
        start, node, code, lang = int(self.start[i]), int(self.node[i]), self.code, self.lang
        close, outer = int(self.close[node]), int(self.parent[node])
        if self.callee[i].startswith(b"new "):
            return False
        word = self._word_before(start)
        if lang == "go":
            if b == 41 and before in self.closes:  # a receiver
                return self._word_before(int(self.open[self.closes[before]])) == b"func"
            return outer in self._declaring_bodies
        if lang == "rust":
            after = int(self.after(np.array([close + 1]))[0])
            return code.startswith(b"=>", after) or outer in self._declaring_bodies
        inner = outer >= 0 and self.array[self.open[outer]] != 123
        m = _AFTER.match(code, close + 1)
        if lang in ("javascript", "typescript"):
            prefix = code[self.statement(start) : start]
            if word == b"function" or prefix.rstrip().endswith(b"*") and b"function" in prefix:
                return True
            prefix = prefix.rpartition(b",")[2] if not inner else prefix
            return outer >= 0 and not inner and bool(m) and m[1] in (b"{", b":") and bool(_MODIFIERS.match(prefix))
        if b == 64:  # an annotation
            return True
        line = code[code.rfind(b"\n", 0, start) + 1 : start]
        if lang in ("c", "cpp") and _DEFINES.search(line):
            return True
        if inner or word in _SPEAKING:
            return False
        prefix = b"\n".join(x for x in code[self.statement(start) : start].split(b"\n") if not x.lstrip().startswith(b"#"))
        prefix = re.split(rb"(?<!:):(?!:)|,", prefix)[-1].strip()
        if not prefix:
            return bool(m) and (m[1] == b"{" or m[1] == b"throws" or m[1] == b":" and lang in ("cpp", "csharp") or b"=" in m[1] and lang == "cpp")
        if not _TYPE_LIKE.match(prefix) or not re.search(rb"\w", prefix) or not m:
            return False
        return m[1] != b":" or lang in ("cpp", "csharp")

    @cached_property
    def closes(self) -> dict[int, int]:
        return dict(zip(self.close.tolist(), range(len(self.close))))

    def _kinds(self) -> list[str]:
        """What each bracket opens: call (a head's), group, array, list (a literal of a slice, array or map), struct,
        object or block."""
        c = self.array[self.open] if len(self.open) else np.zeros(0, np.uint8)
        kinds = np.where(c == 91, "array", np.where(self.head >= 0, "call", "group")).astype(object)
        brace = np.flatnonzero(c == 123)
        if len(brace):
            at = self.open[brace]
            k = np.searchsorted(self._not_word, at) - 1
            word = np.where(k >= 0, self._not_word[np.maximum(k, 0)], -1)  # before the dotted name that touches it
            led, prev = self.char(self.before(word + 1)), self.char(self.before(at))
            touching = self.char(at - 1)
            named = _WORD[touching] & (touching != 46)
            kind = np.where(led == 93, "list", np.where(named, "struct", np.where(np.isin(prev, list(b"(,=:[")), "object", "block"))).astype(object)
            for j in np.flatnonzero((kind == "struct") | (touching == 93) & (kind != "list")).tolist():
                if _LIST.search(self.code, self._clause(int(at[j])), int(at[j])):
                    kind[j] = "list"
            kinds[brace] = kind
        return kinds.tolist()

    def _clause(self, at: int) -> int:
        k = int(np.searchsorted(self._soft, at)) - 1
        return int(self._soft[k]) + 1 if k >= 0 else 0

    @cached_property
    def _soft(self) -> np.ndarray:
        return np.flatnonzero(_SOFT[self.array])

    # What stands around a place

    def element_start(self, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the element of a bracket that ``at`` lies in begins: after its last comma before, or the bracket."""
        key = self._comma_keys
        k = np.searchsorted(key, node * len(self.raw) + at) - 1
        own = (k >= 0) & (self._comma_order_in[np.maximum(k, 0)] == node) if len(key) else np.zeros(len(node), bool)
        return np.where(own, self._comma_order_at[np.maximum(k, 0)] if len(key) else 0, self.open[node]) + 1

    @cached_property
    def _comma_order(self) -> np.ndarray:
        return np.lexsort((self.comma_at, self.comma_in))

    @cached_property
    def _comma_order_in(self) -> np.ndarray:
        return self.comma_in[self._comma_order]

    @cached_property
    def _comma_order_at(self) -> np.ndarray:
        return self.comma_at[self._comma_order]

    @cached_property
    def _comma_keys(self) -> np.ndarray:
        return self._comma_order_in * len(self.raw) + self._comma_order_at

    def keyed(self, node: np.ndarray, at: np.ndarray, quoted: bool = False) -> np.ndarray:
        """Whether the element that begins its value at ``at`` has a key (a literal, if ``quoted``) and a colon before it."""
        k = np.searchsorted(self._not_type, at) - 1
        left = self.before(np.where(k >= 0, self._not_type[np.maximum(k, 0)], -1) + 1)
        key = self.before(left)
        c = self.char(key)
        if quoted:
            return (self.char(left) == 58) & (left >= self.element_start(node, at)) & (c == _MARK)
        return (self.char(left) == 58) & (left >= self.element_start(node, at)) & (_WORD[c] & (c != 46) | np.isin(c, [_MARK, 41, 93]))

    @cached_property
    def _not_type(self) -> np.ndarray:
        return np.flatnonzero(~(_WORD[self.array] | np.isin(self.array, list(b"&*"))))

    def paths(self, nodes: np.ndarray, most: int = 6) -> dict[int, tuple]:
        """For each node, the kinds of it and of the nodes around it, from the inside out (``most`` brackets), ``pair``
        before a bracket in which the one inside stands behind a key."""
        if not len(self.open):
            return {}
        parent = self.parent
        inner = np.where(self.head >= 0, self.start[np.maximum(self.head, 0)] if len(self.start) else 0, self.open)
        known = parent >= 0
        pair = np.zeros(len(parent), bool)
        pair[known] = self.pairs(parent[known], inner[known])
        kinds, up, pairs, found = self.kind, parent.tolist(), pair.tolist(), {}
        callees = {int(n): f"call:{c.decode()}" for n, c in zip(self.node, self.callee)}
        for n in np.unique(nodes[nodes >= 0]).tolist():
            out, k, left = [], n, most
            while k >= 0 and left:
                out.append(callees.get(k) or kinds[k])
                if pairs[k] and left > 1:
                    out.append("pair")
                k, left = up[k], left - 1
            found[n] = tuple(out)
        return found

    def pairs(self, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether ``at`` is the value of a pair in that bracket: behind a key in a literal of a struct, object or list, behind
        a quoted key in any brace."""
        kind = np.array(self.kind, object)[node]
        block = kind == "block"
        return np.where(block, self.keyed(node, at, quoted=True), np.isin(kind, ["struct", "object", "list"]) & self.keyed(node, at))

    def outermost(self, kind: str) -> np.ndarray:
        """For each node, the outermost node of that kind that is it or holds it; -1 if there is none."""
        own = np.flatnonzero(np.array(self.kind, object) == kind)
        if not len(own):
            return np.full(len(self.open), -1)
        far = np.append(-1, np.maximum.accumulate(self.close[own])[:-1])
        own = own[self.open[own] >= far]  # nodes are in the order of their places
        k = np.searchsorted(self.open[own], self.open, side="right") - 1
        holds = (k >= 0) & (self.open < self.close[own[np.maximum(k, 0)]])
        return np.where(holds, own[np.maximum(k, 0)], -1)

    def headed(self) -> np.ndarray:
        """For each node, the nearest node around it that a call head opens; -1 if there is none."""
        up = self.parent.copy()
        while len(bad := np.flatnonzero((up >= 0) & (self.head[np.maximum(up, 0)] < 0))):
            up[bad] = up[up[bad]]  # so far has no head in between
        return up

    def declaring(self, p: int) -> bool:
        """Whether the value after the sign at ``p`` is that of a declaration: ``const x =``, ``Type x =``."""
        if p < 1 or self.code[p] != 61 or self.code[p - 1] in b"=!<>:+-*/%&|^":
            return False
        return bool(_DECLARED.search(self.code[self.statement(p) : p]))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LETTERS = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"_$"
#: Characters of dotted names; what a declared name may follow; brackets, commas and borders; ends of statements, of clauses.
_WORD, _NAMED = _table(_LETTERS + b"."), _table(_LETTERS + b">*&]~")
_TOKEN, _BOUNDARY, _SOFT = _table(b"()[]{},\0"), _table(b"()[]{};\0"), _table(b"(){};,=:\0")
#: Characters of a name, digits, and what type arguments and the names before them are made of.
_ID_PART, _DIGIT, _GENERIC = _table(_LETTERS), _table(bytes(range(48, 58))), _table(_LETTERS + b" \t\r\n\f\v.,:?&[]*'<>-")
_CLASSES = {"word": _table(_LETTERS), "digit": _table(bytes(range(48, 58))), "path": _table(_LETTERS + b".:"), "callee": _table(_LETTERS + b".:>- \t\r\n")}
