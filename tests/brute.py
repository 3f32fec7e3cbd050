"""Plain reference implementations used to check the Spark jobs on small inputs."""

from __future__ import annotations

import bisect
import itertools
import re

from quarry.functions.text import STOP_WORDS

STOP = set(STOP_WORDS)
TOKEN = re.compile(r"[^\w]+|_+")
ITEM = re.compile(r'(-?"[^"]*"?|[^\s"]+)')


def tokens(text: str) -> list[str]:
    return [t for t in TOKEN.split(text.lower()) if t]


def stem(t: str) -> str:
    if len(t) <= 3:
        return t
    if t.endswith("ies") and not t.endswith(("eies", "aies")):
        return t[:-3] + "y"
    if t.endswith("es") and not t.endswith(("aes", "ees", "oes")):
        return t[:-1]
    if t.endswith("s") and not t.endswith(("us", "ss")):
        return t[:-1]
    return t


def doc_vector(text: str) -> list[tuple[int, str]]:
    return [(i + 1, stem(t)) for i, t in enumerate(tokens(text)) if t not in STOP]


def parse_query(q: str):
    """-> list of groups; group = list of (negated, [(offset, lexeme)])"""
    groups, cur = [], []
    for raw in ITEM.findall(q):
        if raw.lower() == "or":
            groups.append(cur)
            cur = []
            continue
        neg = raw.startswith("-") and len(raw) > 1
        phrase = '"' in raw
        toks = [(i, stem(t)) for i, t in enumerate(tokens(raw)) if t not in STOP]
        if not toks:
            continue
        if phrase:
            cur.append((neg, toks))
        else:
            for _, lx in toks:
                cur.append((neg, [(0, lx)]))
    groups.append(cur)
    return [g for g in groups if g]


def item_present(item, vec):
    pos = {}
    for p, lx in vec:
        pos.setdefault(lx, set()).add(p)
    offs = item
    for p, lx in vec:
        if lx == offs[0][1]:
            anchor = p - offs[0][0]
            if all((anchor + o) in pos.get(l, ()) for o, l in offs):
                return True
    return False


def matches(q: str, text: str) -> bool:
    vec = doc_vector(text)
    for g in parse_query(q):
        ok = all(item_present(it, vec) != neg for neg, it in g)
        if ok:
            return True
    return False


def cover_density(q: str, text: str) -> float:
    """Sequential minimal-cover scan (Clarke et al.), weight 0.1 per cover."""
    groups = [set(lx for neg, it in g if not neg for _, lx in it) for g in parse_query(q)]
    groups = [g for g in groups if g]  # a group of negated items has no cover
    allq = set().union(*groups) if groups else set()
    vec = doc_vector(text)
    entries = sorted({p for p, lx in vec if lx in allq})
    at = {}
    for p, lx in vec:
        if lx in allq:
            at.setdefault(p, set()).add(lx)

    def sat(lo, hi):
        seen = set()
        for p in entries:
            if lo <= p <= hi:
                seen |= at[p]
        return any(g <= seen for g in groups)

    score, i = 0.0, 0
    while i < len(entries):
        end = None
        for j in range(i, len(entries)):
            if sat(entries[i], entries[j]):
                end = j
                break
        if end is None:
            break
        begin = end
        while not sat(entries[begin], entries[end]):
            begin -= 1
        noise = (entries[end] - entries[begin]) - (end - begin)
        score += 0.1 / (1 + noise)
        i = begin + 1
    return score


# --- Markdown chunks from the run / join rule ---------------------------
# Line patterns, words that alone are no content, size of a prose piece.
HEAD = re.compile(r"^\s{0,3}#{1,6}\s+.+$")
HEAD_LEVEL = re.compile(r"^\s{0,3}(#{1,6})\s+")
FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
LIST = re.compile(r"^\s*(?:[-*+]\s+|\d+[.)]\s+)")
RULE = re.compile(r"^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
LOW = {"where", "and", "or", "because", "therefore"}
LIMIT = 500


def line_kinds(lines: list[str]) -> str:
    """A letter a line: H heading, R rule, B blank (all outside fences), T any other line."""
    fences_above = itertools.accumulate((bool(FENCE.match(ln)) for ln in lines), initial=0)
    letters = []
    for line, fences in zip(lines, fences_above):
        outside = {"H": HEAD.match(line), "R": RULE.match(line), "B": not line.strip()} if fences % 2 == 0 else {}
        letters.append(next((k for k, hit in outside.items() if hit), "T"))
    return "".join(letters)


def block_spans(lines: list[str], kinds: str) -> list[tuple[int, int]]:
    """Runs of T lines; a run that starts with a list line joins a run with a list line above
    when only blank lines lie between."""
    spans: list[tuple[int, int]] = []
    for run in re.finditer("T+", kinds):
        first, end = run.span()
        if spans and LIST.match(lines[first]):
            above, stop = spans[-1]
            if set(kinds[stop:first]) == {"B"} and any(map(LIST.match, lines[above:stop])):
                first = spans.pop()[0]
        spans.append((first, end))
    return spans


def context_above(lines: list[str], kinds: str, at: int) -> list[str]:
    """Headings in force: going up, each one shallower than all below it."""
    found, depth = [], 7
    for i in range(at - 1, -1, -1):
        if kinds[i] == "H":
            level = HEAD_LEVEL.match(lines[i])[1].count("#")
            if level < depth:
                found.insert(0, lines[i].strip())
                depth = level
    return found


def filled(units: list[str]) -> list[str]:
    """Each piece is the longest run of the remaining units that fits, one unit at least."""
    pieces = []
    while units:
        ends = list(itertools.accumulate(len(u) + 1 for u in units))
        n = max(1, bisect.bisect_right(ends, LIMIT + 1))
        pieces.append(" ".join(units[:n]))
        units = units[n:]
    return pieces


def prose_pieces(text: str) -> list[str]:
    sentences = re.split(r"(?<=[.!?])\s+", text)
    pieces = []
    for oversize, group in itertools.groupby(sentences, key=lambda s: len(s) > LIMIT):
        for units in (map(str.split, group) if oversize else [list(group)]):
            pieces += filled(units)
    return pieces


def chunk(content: str) -> list[str]:
    lines = content.replace("\r\n", "\n").splitlines()
    kinds = line_kinds(lines)
    chunks = []
    for first, end in block_spans(lines, kinds):
        text = "\n".join(lines[first:end]).strip()
        words = [w for ln in text.splitlines() if not (HEAD.match(ln) or RULE.match(ln)) for w in ln.split()]
        if not words or (len(words) == 1 and words[0].casefold() in LOW):
            continue
        whole = len(text) <= LIMIT or FENCE.match(text) or any(map(LIST.match, lines[first:end]))
        above = "\n".join(context_above(lines, kinds, first))
        chunks += ["\n\n".join(filter(None, (above, piece))) for piece in ([text] if whole else prose_pieces(text))]
    return chunks
