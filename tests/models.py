"""Plain versions of the measured quantities, from their definitions (test oracles)."""

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import zip_longest

PAD = object()


def edit_distance(a, b):
    """Fewest insertions, deletions and substitutions that turn sequence ``a`` into ``b``: a recursion on prefixes."""
    a, b = tuple(a), tuple(b)

    @lru_cache(maxsize=None)
    def prefixes(i, j):
        if not i or not j:
            return i + j
        if a[i - 1] == b[j - 1]:
            return prefixes(i - 1, j - 1)
        return 1 + min(prefixes(i - 1, j), prefixes(i, j - 1), prefixes(i - 1, j - 1))

    # Fill the memory diagonal by diagonal, so the recursion stays shallow.
    for k in range(max(len(a), len(b)) + 1):
        prefixes(min(k, len(a)), min(k, len(b)))
    return prefixes(len(a), len(b))


def lev(a, b):
    return edit_distance(a, b)


def word_lev(p, r):
    return edit_distance(p.split(), r.split())


def norm(s):
    return " ".join(s.split())


def agreement(p, r, fill):
    """Equal places of two sequences when the shorter one is filled up, and the number of places."""
    places = list(zip_longest(p, r, fillvalue=fill))
    return sum(x == y for x, y in places), len(places)


def padded(p, r):
    return agreement(p.strip(), r.strip(), " ")


def truncated(p, r):
    return agreement(p.strip(), r.strip(), PAD)


def word_acc(p, r):
    return agreement(p.split(), r.split(), PAD)


def tok13a(line):
    line = line.rstrip()
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(old, new)
    line = f" {line} "
    # The rules of the 13a tokenisation.
    for pattern, by in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        line = re.sub(pattern, by, line)
    return line.split()


def bleu(hyp, ref):
    """Sentence BLEU: brevity penalty times the geometric mean of clipped precisions, empty ones halved ever again."""
    h, r = tok13a(hyp), tok13a(ref)
    grams = lambda words, n: Counter(zip(*(words[k:] for k in range(n))))
    hits = [sum((grams(h, n) & grams(r, n)).values()) for n in range(1, 5)]
    if not sum(hits):
        return 0.0
    order = min(4, len(h))
    empty, logs = 0, 0.0
    for n in range(1, order + 1):
        empty += not hits[n - 1]
        share = hits[n - 1] or 0.5 ** empty
        logs += math.log(share / (len(h) - n + 1))
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(logs / order)
