"""Fuzzy similarity of a query and a text, from the published definition of the weighted ratio.

Ratios are 200 times the longest common subsequence over the sum of both lengths; partial ratios take the best
window of the longer text; token ratios compare sorted words and sets of words. Differences of length choose
which of them count, and by how much.
"""

from __future__ import annotations

from collections import Counter


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100; two empty texts are alike."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Ratio of the shorter text and its best window of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, best, own = len(a), 0.0, Counter(a)
    inside: Counter[str] = Counter()
    bound = 0  # letters that the window shares with the shorter text, whatever their order
    for at in range(1 - n, len(b)):
        lo, hi = max(0, at), min(len(b), at + n)
        if at + n <= len(b):
            c = b[hi - 1]
            inside[c] += 1
            bound += inside[c] <= own[c]
        if at > 0:
            c = b[at - 1]
            bound -= inside[c] <= own[c]
            inside[c] -= 1
        # The best alignment begins or ends on a letter of the shorter text; and only a window that can be better is tried.
        if 200.0 * bound / (n + hi - lo) > best and (b[lo] in own or b[hi - 1] in own):
            best = max(best, ratio(a, b[lo:hi]))
    return best


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def _sets(a: str, b: str) -> tuple[str, str, str]:
    wa, wb = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(x)) for x in (wa & wb, wa - wb, wb - wa))


def token_ratio(a: str, b: str) -> float:
    """The better one of the ratios of sorted words and of sets of words."""
    both, only_a, only_b = _sets(a, b)
    if both and (not only_a or not only_b):
        return 100.0
    left, right = (both + " " + only_a).strip(), (both + " " + only_b).strip()
    out = max(ratio(_sorted_words(a), _sorted_words(b)), ratio(left, right))
    return max(out, ratio(both, left), ratio(both, right)) if both else out


def partial_token_ratio(a: str, b: str) -> float:
    """The same with partial ratios; a shared word is a whole match."""
    both, only_a, only_b = _sets(a, b)
    return 100.0 if both else max(partial_ratio(_sorted_words(a), _sorted_words(b)), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """From 0 to 100; 0 where either is empty. Case counts."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if longer < 1.5:
        return max(plain, token_ratio(a, b) * 0.95)
    scale = 0.9 if longer < 8 else 0.6
    return max(plain, partial_ratio(a, b) * scale, partial_token_ratio(a, b) * 0.95 * scale)
