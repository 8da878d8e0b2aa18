"""Sentence boundaries of one text, across languages and scripts. Pure functions; :mod:`weftline.llm.sentences` applies them.

A text is first cut into blocks: code, bare links, list items, quotes and paragraphs. In a paragraph the terminators are the nodes
of a lattice, and a path from its start to its end a way to cut it: an edge is a sentence from one terminator to another. Ending at a
terminator and passing over it cost what speaks against either: abbreviations, ordinals, decimals, quotes and brackets that close, what
follows; an edge costs more that holds hardly a character, or a bracket only in part. The sentences are the cheapest path, found in
time linear in the text.

Scripts without spaces between words are segmented by the cheapest path through a lattice of dictionary words, characters that no
word covers going by clusters; a gap then ends a sentence by the final particle before it and the opening words after it.
"""

from __future__ import annotations

import bisect
import functools
import re

# ---------------------------------------------------------------- blocks

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LINK = re.compile(r"^\s*<?(?:https?|ftp)://[^\s<>]+>?\s*$", re.I)
_PRE, _END_PRE = re.compile(r"<pre\b", re.I), re.compile(r"</pre>", re.I)
_BULLET = re.compile(r"^ {0,3}[*+\-•‣▪◦] +")
_NUMBER = re.compile(r"^ {0,3}(\d{1,3})([.)]) +")
_QUOTE = re.compile(r"^ {0,3}>+ ?")

CODE, TEXT = "code", "text"


def blocks(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, length of the mark at its start): blocks in order; every non-blank character is in exactly one."""
    found: list[tuple[int, int, str, int]] = []
    at = 0
    while (begin := _PRE.search(text, at)) and (closed := text.find(">", begin.end())) >= 0 and (end := _END_PRE.search(text, closed + 1)):
        _lines(text, at, begin.start(), found)
        found.append((begin.start(), end.end(), CODE, 0))
        at = end.end()
    _lines(text, at, len(text), found)
    return found


def _lines(text: str, at: int, end: int, found: list) -> None:
    open_at, mark = -1, 0  # the open paragraph or item
    item, number = False, 0  # whether the line before is in a list; its number
    fence, code_at, indent_at, indent_end = "", 0, -1, 0

    def close(stop: int) -> None:
        nonlocal open_at, mark
        if open_at >= 0:
            found.append((open_at, stop, TEXT, mark))
        open_at, mark = -1, 0

    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        line = text[at:stop]
        if fence:
            m = _FENCE.match(line)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                found.append((code_at, at + m.end(), CODE, 0))
                fence = ""
                if line[m.end() :].strip():
                    open_at = at + m.end()
            at = stop + 1
            continue
        m = _FENCE.match(line)
        if m and not line[m.end() :].strip().count("`"):
            close(at)
            if indent_at >= 0:
                found.append((indent_at, indent_end, CODE, 0))
                indent_at = -1
            fence, code_at = m.group(1), at
            at = stop + 1
            continue
        blank = not line.strip()
        indented = not blank and (line.startswith("    ") or line.startswith("\t"))
        if indent_at >= 0:
            if indented:
                indent_end = stop
                at = stop + 1
                continue
            found.append((indent_at, indent_end, CODE, 0))
            indent_at = -1
        if blank:
            close(at)
            item = False
        elif indented and open_at < 0:
            indent_at, indent_end = at, stop
        elif _LINK.match(line):
            close(at)
            found.append((at, stop, CODE, 0))
        else:
            m = _BULLET.match(line) or _QUOTE.match(line)
            n = None if m else _NUMBER.match(line)
            if n and open_at >= 0 and (word := _NEXT.match(line, n.end())) and word.group().lower() in AFTER_ORDINAL:
                n = None  # an ordinal that a wrapped line begins with
            if n and (open_at < 0 or item) or n and int(n.group(1)) == 1:
                if open_at < 0 or not item or int(n.group(1)) == number + 1 or int(n.group(1)) == 1:
                    m, number = n, int(n.group(1))
            if m:
                close(at)
                open_at, mark, item = at, m.end(), True
            elif open_at < 0:
                open_at, mark = at, 0
        at = stop + 1
    if fence:
        found.append((code_at, end, CODE, 0))
    if indent_at >= 0:
        found.append((indent_at, indent_end, CODE, 0))
    close(end)


# ---------------------------------------------------------------- spaced scripts

#: Words before a full stop, lower case. Fixed values. They never end a sentence ...
NEVER = frozenset(
    "dr prof mr mrs ms mme mlle sr sra srta dra st vgl bzw cf vs e.g i.e z.b d.h u.a s.o p.ej p.ex resp evtl ggf sog "
    "т.е напр им проф акад κ π.χ βλ δρ καθ д د डॉ प्रो श्री jr gen col rev hon eng lt sgt capt maj pres gov sen sig sigg dott ing mgr phdr".split()
)
#: ... end none before a number ...
BEFORE_NUMBER = frozenset(
    "fig figs sec secs p pp no nos nr abs abb tab eq eqs vol ch chap art ver v ca approx appr max min env aprox pág págs pag núm "
    "см ок рис стр табл гл σελ εικ αρ पृ ص s kap bd ziff lit ann sect".split()
)
#: ... or may end one or not, as the next word tells.
MAY_END = frozenset("etc usw a.m p.m т.д т.п г гг мин сек руб κ.λπ κ.λ.π κ.ά al inc ltd co corp jr".split())
#: Lower-case words that go on after an abbreviation that may end a sentence. Other lower-case words are names that open one.
GOES_ON = frozenset(
    "a an and are as at before after but by for from has have if in into is it its nor of on or per so than that the then this to "
    "until via was were when where which while will with without yet".split()
)
#: Words after which dots of suspense don't end a sentence.
CONJUNCTIONS = frozenset("but and or so yet then only though because pero mais aber sondern und oder y o e ni et ou и но а или αλλά και ή".split())
#: German words after an ordinal number, and before one.
AFTER_ORDINAL = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember mal jahrhundert stock tag woche monat jahr".split())
BEFORE_ORDINAL = frozenset("am zum vom beim im der dem den des die das bis ab seit jeder jedem jeden".split())

_OPEN = {"„": "“”", "“": "”", "«": "»", "‹": "›", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》", "【": "】", "〈": "〉", "﹁": "﹂"}
_CLOSERS = frozenset("“”»›)]）」』》】〉﹂\"")
_QUOTES = frozenset("“”»›」』》〉﹂\"")
_MARKS = re.compile(r"`+[^`]*`+|(?:https?|ftp)://[!-~]+|[„“”«»‹›()\[\]（）「」『』《》【】〈〉\"]|[.!?…。！？｡؟۔।॥;;‼⁇⁈⁉។၊။։።፧]+", re.I)
_FULL = ".。｡۔।॥"
_WORD = re.compile(r"(?:.*[\s(\[{«„“\"'¿¡（「『《])?(.*)", re.S)
_NEXT = re.compile(r"[^\s.,;:!?)\]»”]+")
_LETTERS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_MISSING = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω](?:[a-zà-öø-ÿа-яα-ω']+[ ,\n]|[ ])")


def _spans(text: str, start: int, end: int):
    """(closed spans as {end: start}, terminators) of a paragraph; code spans and links are passed over."""
    stack: list[tuple[str, int]] = []
    closable: dict[str, int] = {}  # how many open spans each mark would close
    closed: dict[int, int] = {}
    stops: list[tuple[int, int]] = []

    def push(c: str, at: int) -> None:
        stack.append((c, at))
        for x in _OPEN.get(c, c):
            closable[x] = closable.get(x, 0) + 1

    def close(c: str, at: int) -> bool:
        if not closable.get(c):
            return False
        while True:
            o, begin = stack.pop()
            for x in _OPEN.get(o, o):
                closable[x] -= 1
            if c in _OPEN.get(o, o):
                closed[at] = begin
                return True

    for m in _MARKS.finditer(text, start, end):
        mark, c = m.group(), text[m.start()]
        if c == "`":
            closed[m.end() - 1] = m.start()
        elif len(mark) > 6 and "://" in mark:
            link = mark.rstrip(".,;:!?)\"'")
            closed[m.start() + len(link) - 1] = m.start()
            rest = mark[len(link) :]
            if rest and rest[0] in ".!?":
                stops.append((m.start() + len(link), m.start() + len(link) + len(rest) - len(rest.lstrip(".!?"))))
        elif c == '"':
            if not close(c, m.start()):
                push(c, m.start())
        elif c in _OPEN and not (c == "“" and stack and stack[-1][0] == "„"):
            push(c, m.start())
        elif c in _CLOSERS:
            close(c, m.start())
        else:
            stops.append((m.start(), m.end()))
    return closed, stops


def _word_before(text: str, start: int, at: int) -> str:
    """The word before a place; of one longer than 40 characters, which is in no list, its end."""
    return _WORD.match(text, max(start, at - 40), at).group(1)


def _abbreviation(text: str, start: int, at: int, next_at: int, end: int) -> str:
    """The class of a full stop at ``at``: '' (none), 'never' or 'may'."""
    word = _word_before(text, start, at).lower()
    following = text[next_at] if next_at < end else ""
    if not word:
        return "never" if following.isalnum() and next_at == at + 1 else ""
    before = _word_before(text, start, max(start, at - len(word) - 1)).lower() if len(word) <= 2 else ""
    pair = f"{before.rstrip('.')}.{word}" if before.endswith(".") else word
    if pair in MAY_END or word in MAY_END and not (word == "г" and before.endswith(".")):
        return "may"
    if word in NEVER or pair in NEVER:
        return "never"
    if following.isdigit() and word in BEFORE_NUMBER:
        return "never"
    if following.islower() and _LETTERS.fullmatch(word):
        return "never"
    tail = word.rsplit(".", 1)[-1].lstrip("-–")
    if len(tail) == 1 and tail.isalpha() and word == tail:
        # an initial, or the first part of an abbreviation; a small letter before a capitalised word is neither
        initial = text[at - 1].isupper() or not (text[at - 1].islower() and following.isupper())
        if initial or re.match(r"\w\.", text[next_at : next_at + 2]):
            return "never"
    if word in BEFORE_NUMBER and _NEXT.match(text, next_at) and _NEXT.match(text, next_at).group().lower() in BEFORE_NUMBER:
        return "never"
    if word.isdigit() and len(word) <= 2 and following.isalpha():
        if _NEXT.match(text, next_at).group().lower() in AFTER_ORDINAL:
            return "never"
        if following.isupper():
            ahead = text[max(start, at - len(word) - 12) : at - len(word)].lower().split()
            if ahead and ahead[-1] in BEFORE_ORDINAL:
                return "never"
    return ""


#: Costs of a path through the lattice of terminators: what is certain, likely, or only a little likelier.
SURE, LIKELY, SLIGHT = 8, 4, 2
#: Cost of a sentence that has hardly a character besides its mark.
TINY = 3


def _weigh(text: str, start: int, stop: tuple[int, int], closed: dict[int, int], end: int) -> tuple[int, int, int, int] | None:
    """(place after the sentence, cost of ending at a terminator, cost of passing over it, start of a bracket that closes there or -1);
    None if no sentence can end there. Ending inside a bracket costs nothing for the sentence that begins with it."""
    at, after = stop
    mark = text[at:after]
    b, quote, bracket_at, quote_at = after, False, -1, -1
    while b < end:  # closing quotes and brackets, in French and Russian with a blank before
        c = b + 1 if text[b] in "   " and b + 1 < end and text[b + 1] in "»" else b
        if c >= end or c not in closed or text[c] not in _CLOSERS or closed[c] > at:
            break
        if text[c] in _QUOTES:
            quote, quote_at = True, closed[c]
        else:
            bracket_at = closed[c]
        b = c + 1
    n = b
    while n < end and text[n].isspace():
        n += 1
    if n >= end:
        return end, 0, SURE, -1
    following, gap = text[n], n > b
    if mark.strip(";;") == "" and not (at > start and _GREEK.match(text[at - 1])):
        return None
    if following in ",;:—–،؛、，；：" or (following in "-" and gap):
        return None
    dots = mark.endswith("...") or mark.endswith("…")
    upper_or_other = not following.islower()
    caseless = following.isalpha() and not following.isupper() and not following.islower()
    if quote:
        introduced = text[start:quote_at].rstrip()[-1:] in (":", "：") and quote_at > start
        if following.islower():
            return (b, 0, LIKELY, -1) if introduced and mark[-1] in _FULL and following.isascii() and not dots else (b, LIKELY, 0, -1)
        if caseless or not gap and not following.isupper():
            return (b, 0, LIKELY, -1) if introduced and mark[-1] in _FULL else (b, LIKELY, 0, -1)
        return b, 0, LIKELY, -1
    if bracket_at >= 0:
        return b, SURE, 0, bracket_at
    if dots and mark[-1] not in "。！？":
        if mark[-1] == "…" or gap:
            if following.islower():
                return (b, LIKELY, 0, -1) if _NEXT.match(text, n).group().lower() in CONJUNCTIONS or not following.isascii() else (b, 0, SLIGHT, -1)
            return b, 0, LIKELY, -1
        return (b, 0, SLIGHT, -1) if following.isupper() and _MISSING.match(text, n) else (b, SURE, 0, -1)
    if mark == ".":
        if not gap:
            word = _word_before(text, start, at)
            if not word or following.isspace() or _abbreviation(text, start, at, n, end):
                return None
            plain = word[-1].isalnum() or word[-1] in "`)%"
            if following in "`(\"“«" and n not in closed:
                return (b, 0, LIKELY, -1) if plain and len(word) > 1 else (b, LIKELY, 0, -1)
            return (b, 0, LIKELY, -1) if plain and (len(word) > 1) and _MISSING.match(text, n) and "://" not in word else (b, LIKELY, 0, -1)
        kind = _abbreviation(text, start, at, n, end)
        if kind == "never":
            return b, SURE, 0, -1
        if kind == "may" and following.islower():
            return (b, 0, SLIGHT, -1) if following.isascii() and _NEXT.match(text, n).group().lower() not in GOES_ON else (b, SLIGHT, 0, -1)
        return b, 0, SLIGHT if following.islower() else SURE, -1
    return (b, 0, SURE, -1) if gap or upper_or_other or mark[-1] not in ".!?" else (b, LIKELY, 0, -1)


def _nodes(text: str, start: int, end: int) -> list[tuple[int, int, int, int, int, int]]:
    """The lattice's nodes, in order: (terminator, place after the sentence, start of the next, cost of ending, cost of passing,
    bracket) of every terminator at which a sentence can end."""
    closed, stops = _spans(text, start, end)
    inside = sorted(((s, e) for e, s in closed.items()), key=lambda x: x[0])
    nodes, k, reach = [], 0, -1
    for stop in stops:
        while k < len(inside) and inside[k][0] < stop[0]:
            reach = max(reach, inside[k][1])
            k += 1
        if reach >= stop[1] and text[stop[1]] not in _CLOSERS and not text[stop[1]].isspace():
            continue  # inside of a span that doesn't close here
        found = _weigh(text, start, stop, closed, end)
        if found is None or found[0] <= reach:
            continue
        after = found[0]
        while after < end and text[after].isspace():
            after += 1
        nodes.append((stop[0], found[0], after, *found[1:]))
    return nodes


def _spaced(text: str, start: int, end: int, begin: int, out: list) -> None:
    """Sentences of a paragraph as (start, end): the cheapest path. ``begin``: where its text begins, after a list mark.

    With the costs of passing summed up along the paragraph, the best edge into a node comes from the node before it that is least in
    cost less that sum, whatever lies between. Only edges whose cost depends on where they begin are looked at one by one: those from
    the bracket that closes at the node, and tiny ones.
    """
    nodes = _nodes(text, start, end)
    starts, costs, sums, previous = [begin], [0], [0], [-1]  # node 0 is the paragraph's start
    ready, by_start, passing, least = 0, {begin: 0}, 0, None
    for at, _, after, ending, passed, bracket in [*nodes, (end, end, end, 0, 0, -1)]:
        # edges from nodes at least three characters back; of equal ones the one from the last node
        while ready < len(starts) and starts[ready] + 2 < at:
            if least is None or costs[ready] - sums[ready] <= least[0]:
                least = costs[ready] - sums[ready], ready
            ready += 1
        choices = [] if least is None else [(least[0] + passing + ending, -least[1])]
        near = ready
        while near < len(starts) and starts[near] <= at:
            choices.append((costs[near] + passing - sums[near] + ending + (TINY if at < end and starts[near] > begin else 0), -near))
            near += 1
        if bracket >= 0 and (i := by_start.get(bracket)) is not None:
            choices.append((costs[i] + passing - sums[i], -i))
        cost, back = min(choices, default=(1 << 60, 0))
        starts.append(after)
        costs.append(cost)
        passing += passed if bracket < 0 or by_start.get(bracket) is None else SURE
        sums.append(passing)
        previous.append(-back)
        by_start[after] = len(starts) - 1
    path, i = [], len(starts) - 1
    while i > 0:
        path.append(i)
        i = previous[i]
    first = start
    for i in reversed(path):
        stop = end if i > len(nodes) else nodes[i - 1][1]
        if first < stop:
            out.append((first, stop))
        first = end if i > len(nodes) else nodes[i - 1][2]


# ---------------------------------------------------------------- scripts without spaces between words

_SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_RUN = re.compile(r"[\u0e00-\u0e7f]+|[\u0e80-\u0eff]+|[\u1000-\u109f]+|[\u1780-\u17ff]+")
#: A character with what is written before, above, below and after it, which no boundary divides.
_CLUSTER = re.compile(r"[\u0e40-\u0e44\u0ec0-\u0ec4]?[^\W\d_](?:[\u0e30-\u0e3a\u0e45\u0e47-\u0e4e\u0eb0-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u1056-\u1060\u17b4-\u17d3\u17dd]|\u1039.|\u17d2.)*|.", re.S)
#: Words that close a sentence, of Thai, Lao, Khmer and Burmese. Fixed values.
FINAL = frozenset(
    "ครับ ค่ะ คะ ไหม มั้ย จ้ะ จ้า จ๊ะ ฮะ หรือเปล่า หรือยัง ล่ะ เถอะ สิ นะ ນະ ເດີ ບໍ ເນາະ ແດ່ ចាស៎ ទេ ណា ហើយឬនៅ တယ် ပါတယ် ပါ သည် မယ် လား နော်".split()
)
#: Words that open one: greetings, thanks and questions, links to what was said, times, and persons that speak.
OPENING = frozenset(
    "ขอบคุณ ขอโทษ สวัสดี ทำไม อย่างไรก็ตาม ดังนั้น นอกจากนี้ ตั้งแต่ ต่อมา จากนั้น เพราะฉะนั้น ไม่ทราบ วันนี้ พรุ่งนี้ เมื่อวาน เมื่อวานนี้ มีใคร พอ ลอง ผม ดิฉัน ฉัน เรา เขา ເປັນຫຍັງ ຂອບໃຈ ສະບາຍດີ ດັ່ງນັ້ນ ហេតុអ្វី អរគុណ សួស្តី ដូច្នេះ ဘာကြောင့် ကျေးဇူး မင်္ဂလာပါ ဒါကြောင့်".split()
)
#: Words after which a gap ends no sentence.
_GO_ON = frozenset("และ หรือ ว่า แต่ ແລະ ຫຼື និង ឬ နှင့်".split())


class Words:
    """Best paths through the lattice of a dictionary's words; :data:`FINAL` and :data:`OPENING` belong to every dictionary."""

    def __init__(self, words=()):
        self.words = frozenset(words) | FINAL | OPENING | _GO_ON
        self.longest: dict[str, int] = {}
        for w in self.words:
            self.longest[w[:1]] = max(self.longest.get(w[:1], 0), len(w))
        # what is joined to an opening word without a gap: a final particle
        ends = sorted((x for x in FINAL if len(x) > 2 and x != "ไหม"), key=len, reverse=True)
        self.joined = re.compile(rf"(?:{'|'.join(ends)})(?={'|'.join(sorted(OPENING, key=len, reverse=True))})")
        self.split = functools.lru_cache(maxsize=100_000)(self._split)

    def _split(self, run: str) -> tuple[str, ...]:
        """The words of a run: fewest clusters outside of words, then fewest words."""
        edges = [0]
        for m in _CLUSTER.finditer(run):
            edges.append(m.end())
        best: dict[int, tuple[int, int, int]] = {0: (0, 0, 0)}
        for k, at in enumerate(edges[:-1]):
            outside, count, _ = best[at]
            choice = (outside + 1, count + 1, at)
            if edges[k + 1] not in best or choice < best[edges[k + 1]]:
                best[edges[k + 1]] = choice
            reach = at + self.longest.get(run[at], 0)
            for stop in edges[k + 1 :]:
                if stop > reach:
                    break
                if run[at:stop] in self.words:
                    choice = (outside, count + 1, at)
                    if stop not in best or choice < best[stop]:
                        best[stop] = choice
        path, i = [], len(run)
        while i:
            path.append(run[best[i][2] : i])
            i = best[i][2]
        return tuple(reversed(path))

    def before(self, text: str, runs: list[tuple[int, int]], at: int) -> str:
        """The last word of the run that ends at ``at``, or ''."""
        i = bisect.bisect_left(runs, (at,)) - 1
        return self.split(text[slice(*runs[i])])[-1] if i >= 0 and runs[i][1] == at else ""

    def opens(self, text: str, runs: list[tuple[int, int]], at: int) -> bool:
        """Whether opening words, one or several of a dictionary's, begin at ``at``."""
        i = bisect.bisect_left(runs, (at,))
        if i == len(runs) or runs[i][0] != at:
            return False
        found = self.split(text[slice(*runs[i])])
        return found[0] in OPENING or "".join(found[:2]) in OPENING

    def first(self, text: str, runs: list[tuple[int, int]], at: int) -> str:
        i = bisect.bisect_left(runs, (at,))
        return self.split(text[slice(*runs[i])])[0] if i < len(runs) and runs[i][0] == at else ""


_GAP = re.compile(r"\s+")


def _spaceless(text: str, start: int, end: int, begin: int, out: list, words: Words) -> None:
    """Sentences of a paragraph without spaces between words: gaps, by the words at both sides, besides the terminators of :func:`_spaced`."""
    closed, _ = _spans(text, start, end)
    covered: list[list[int]] = []  # closed spans, joined where they overlap
    for s, e in sorted((s, e) for e, s in closed.items()):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    inside = lambda at: (i := bisect.bisect_left(covered, [at]) - 1) >= 0 and covered[i][1] >= at
    runs = [m.span() for m in _RUN.finditer(text, begin, end)]
    cuts = set()
    for m in _GAP.finditer(text, begin, end):
        if m.end() >= end or inside(m.start()):
            continue
        last = words.before(text, runs, m.start())
        if "\n" in m.group() or last in FINAL and words.first(text, runs, m.end()) not in FINAL or last and last not in _GO_ON and words.opens(text, runs, m.end()):
            cuts.add(m.start())
    for m in words.joined.finditer(text, begin, end):
        if not inside(m.end()):
            cuts.add(m.end())
    at = start
    for c in [*sorted(cuts), end]:
        _spaced(text, at, c, max(at, begin), out)
        at = c
        while at < end and text[at].isspace():
            at += 1


# ---------------------------------------------------------------- all


NO_WORDS = Words()


def units(text: str | None, words: Words = NO_WORDS) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in code points, end exclusive; none for a null or blank text. ``words``: the
    dictionary of scripts without spaces."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    for start, end, kind, mark in blocks(text):
        while start < end and text[start].isspace():
            start, mark = start + 1, mark - 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start >= end:
            continue
        if kind == CODE:
            out.append((start, end))
            continue
        found: list[tuple[int, int]] = []
        begin = min(start + max(mark, 0), end)
        if _SPACELESS.search(text, start, end):
            _spaceless(text, start, end, begin, found, words)
        else:
            _spaced(text, start, end, begin, found)
        for s, e in found:
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
    return out
