"""Plain versions of the operators' contracts, row by row."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return words((text or "").translate(A_TO_Z))


def rule_counts(text):
    text = text or ""
    own = words(text)
    windows = Counter(tuple(own[i:i + 8]) for i in range(len(own) - 7))
    covered = set()
    for i in range(len(own) - 7):
        if windows[tuple(own[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def shingle_set(text):
    own = lowered(text)
    if not own:
        return frozenset()
    return frozenset(tuple(own[i:i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)])


def components(rows, threshold=75):
    """{doc_id: smallest reachable doc_id} over (doc_id, text) rows."""
    parent = {doc_id: doc_id for doc_id, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows]
    for i, (a, left) in enumerate(sets):
        for b, right in sets[:i]:
            if left and right and 100 * len(left & right) >= threshold * len(left | right):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {doc_id: find(doc_id) for doc_id in parent}


def luhn(digits):
    total = 0
    for at, digit in enumerate(digits[::-1]):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def personal(text):
    found = []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group())):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(kind, start, end) for start, kind, end in sorted(found)]
