"""Plain-Python BLEU and chrF written from the published formulas, for comparison."""

import math
import re
from collections import Counter


def tokens(line):
    line = line.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(old, new)
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def count(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def bleu_stats(hyp, ref):
    h, r = tokens(hyp), tokens(ref)
    correct = [sum((count(h, n) & count(r, n)).values()) for n in range(1, 5)]
    total = [max(len(h) - n + 1, 0) for n in range(1, 5)]
    return [len(h), len(r), *correct, *total]


def bleu(stats):
    sys_len, ref_len, correct, total = stats[0], stats[1], stats[2:6], stats[6:10]
    if not any(correct):
        return 0.0
    bp = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    smooth, logs = 1.0, []
    for c, t in zip(correct, total):
        if t == 0:
            break
        if c == 0:
            smooth *= 2
            logs.append(math.log(100 / (smooth * t)))
        else:
            logs.append(math.log(100 * c / t))
    return bp * math.exp(sum(logs) / len(logs))


def chrf_stats(hyp, ref):
    h, r = "".join(hyp.split()), "".join(ref.split())
    hyp_n, ref_n, match_n = [], [], []
    for n in range(1, 7):
        ch, cr = count(h, n), count(r, n)
        hyp_n.append(sum(ch.values()) if cr else 0)
        ref_n.append(sum(cr.values()))
        match_n.append(sum((ch & cr).values()))
    return [*hyp_n, *ref_n, *match_n]


def chrf(stats):
    p = r = used = 0
    for h, f, m in zip(stats[:6], stats[6:12], stats[12:]):
        if h and f:
            p, r, used = p + m / h, r + m / f, used + 1
    if not used or p + r == 0:
        return 0.0
    p, r = p / used, r / used
    return 100 * 5 * p * r / (4 * p + r)
