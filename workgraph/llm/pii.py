"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans they miss."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, leftmost and non-overlapping within each kind, by start, then kind.

    Each is found from an anchor (the @, a run's first digit, the +), so that long runs without a match stay linear.
    """
    out: list[Span] = []
    at = text.find("@")
    free = 0  # matches start here at the earliest
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the conditional random field -------------------------------------------------------------------------------------

MOST_TOKENS, MOST_CHARS = 6, 64
_TOKEN = re.compile(r"(?<!\S)(?=[^\s0-9@\[(+]*+[0-9@\[(+])\S++")
_SPELLED = re.compile(r"(?<!\S)[^\s@]{1,40} ?[\[(] ?at ?[\])] ?[^\s@]{1,40}(?: ?[\[(] ?dot ?[\])] ?[^\s@]{1,40})*", re.I)
_BRACKET_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.I)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]+)+", re.I)
_NUMBER = re.compile(r"\+?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}")
_GROUPS = re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}[ .-]?[0-9]{0,4}")
_QUAD = re.compile(r"[0-9]{1,3}(?:(?:\.|[\[(]\.[\])])[0-9]{1,3}){3}")
_EDGE = ".,;:!?\"'<>{}|"
FEATURES = ("one", "at", "mail", "luhn", "groups", "quad", "small quad", "plus", "area", "number", "letters", "edge", "d0-6", "d7-8", "d9-11", "d12-15", "d16-19", "d20", "tokens2", "tokens4", "breaks", "long")


def features(span: str, n_tokens: int) -> np.ndarray:
    """What a whole candidate span looks like; no feature looks at one token alone."""
    d = "".join(c for c in span if "0" <= c <= "9")
    n = len(d)
    quad = _QUAD.fullmatch(span) is not None
    return np.array(
        [1, bool(_AT.search(span)), bool(_MAIL.fullmatch(span)), 12 <= n <= 19 and luhn(d), bool(_GROUPS.fullmatch(span)), quad, quad and all(int(x) <= 255 for x in re.findall("[0-9]+", span)), span[:1] == "+", bool(re.search(r"\([0-9]{2,4}\)", span)), bool(_NUMBER.fullmatch(span)), any(c.isalpha() for c in span), span[:1] in _EDGE or span[-1:] in _EDGE, n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n >= 20, n_tokens >= 2, n_tokens >= 4, len(re.findall(r"[ .()-]+", span)) >= 2, len(span) > 32],
        float,
    )


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that a candidate may lie in: each has a digit, @, bracket or plus. Tokens lose edge
    punctuation; text outside regions can hold no candidate, so leaving it out changes no decision."""
    spelled: list[tuple[int, int]] = []
    if _BRACKET_AT.search(text):  # an address with its @ spelled out is one token
        for m in _SPELLED.finditer(text):
            spelled.append(m.span())
            yield [(m.start(), m.end() - (text[m.end() - 1] in _EDGE))]
    run: list[tuple[int, int]] = []
    last, k = -1, 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while k < len(spelled) and spelled[k][1] <= a:
            k += 1
        if k < len(spelled) and spelled[k][0] < b:
            continue
        if run and not (a - last <= 2 and "\n" not in text[last:a]):
            yield run
            run = []
        last = b
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        run.append((a, b))
    if run:
        yield run


def _candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """(first token, token after the last, features) of every segment of bounded length."""
    return [(i, j, features(text[tokens[i][0] : tokens[j - 1][1]], j - i)) for i in range(len(tokens)) for j in range(i + 1, min(i + MOST_TOKENS, len(tokens)) + 1) if 0 < tokens[j - 1][1] - tokens[i][0] <= MOST_CHARS]


#: The state after a token outside any entity, behind those of KINDS; also where a region begins.
OUTSIDE = len(KINDS)
Weights = tuple[np.ndarray, np.ndarray]  # [kind, feature], and [state before, kind]


_FIRST = [OUTSIDE, *range(OUTSIDE)]  # states in the order in which ties are settled


def _best(scores: np.ndarray) -> int:
    return _FIRST[int(scores[_FIRST].argmax())]


def held_tokens(tokens: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int, int]]:
    """(first token, token after the last, kind) of what base spans cover, in order: base spans stand, and what overlaps
    one before it goes with that one."""
    out: list[tuple[int, int, int]] = []
    starts = [a for a, _ in tokens]
    for kind, a, b in base:
        i = bisect_right(starts, a) - 1
        if i < 0 or tokens[i][1] <= a:
            i += 1
        j = bisect_left(starts, b)
        if i >= j:
            continue
        if out and i < out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]), out[-1][2])
        else:
            out.append((i, j, KINDS.index(kind)))
    return out


def decode(text: str, tokens: list[tuple[int, int]], weights: Weights, margin: float = 0.0, base: list[Span] = ()) -> list[Span]:
    """The best joint choice of boundaries and kinds over a region's tokens. A segmentation scores, for each entity, its
    span's features and the step from the state before it, less margin; a token outside scores 0. Base spans are entities that every
    segmentation has (without a score of their own), so no candidate runs into one. Ties: fewer entities, then the earlier kind."""
    own, step = weights
    n, held = len(tokens), held_tokens(tokens, base)
    taken = [False] * (n + 1)
    for i, j, _ in held:
        taken[i:j] = [True] * (j - i)
    best = np.full((n + 1, OUTSIDE + 1), -np.inf)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    best[0, OUTSIDE] = 0
    ends: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, j, f in _candidates(text, tokens):
        if not any(taken[i:j]):
            ends.setdefault(j, []).append((i, own @ f - margin))
    fixed = {j: (i, k) for i, j, k in held}
    for j in range(1, n + 1):
        if not taken[j - 1]:
            k = _best(best[j - 1])
            best[j, OUTSIDE], back[j, OUTSIDE] = best[j - 1, k], (j - 1, k)
            for i, score in ends.get(j, ()):
                through = best[i][:, None] + step
                for kind in range(OUTSIDE):
                    y = _best(through[:, kind])
                    if through[y, kind] + score[kind] > best[j, kind]:
                        best[j, kind], back[j, kind] = through[y, kind] + score[kind], (i, y)
        elif j in fixed:
            i, kind = fixed[j]
            y = _best(best[i] + step[:, kind])
            best[j, kind], back[j, kind] = best[i, y] + step[y, kind], (i, y)
    out, j, state = [], n, _best(best[n])
    while j > 0:
        i, y = back[j, state]
        if state != OUTSIDE and j not in fixed:
            out.append((KINDS[state], tokens[i][0], tokens[j - 1][1]))
        j, state = i, y
    return out[::-1]


Region = tuple[int, list[tuple[int, int]], np.ndarray, list[int | None]]  # tokens, candidates, their features, their gold kinds


def likelihood(region: Region, weights: Weights) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood of a region's gold segmentation, its gradients by both kinds of weights), by forward and backward sums."""
    n, where, f, gold = region
    own, step = weights
    s = f @ own.T
    fore, aft = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf)
    fore[0, OUTSIDE] = 0
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    begins: list[list[int]] = [[] for _ in range(n + 1)]
    for x, (i, j) in enumerate(where):
        ends[j].append(x)
        begins[i].append(x)
    into = np.full((n + 1, OUTSIDE), -np.inf)  # sums over the state before, by where an entity begins
    into[0] = np.logaddexp.reduce(fore[0][:, None] + step, axis=0)
    for j in range(1, n + 1):
        fore[j, OUTSIDE] = np.logaddexp.reduce(fore[j - 1])
        if ends[j]:
            fore[j, :OUTSIDE] = np.logaddexp.reduce([into[where[x][0]] + s[x] for x in ends[j]], axis=0)
        into[j] = np.logaddexp.reduce(fore[j][:, None] + step, axis=0)
    aft[n] = 0
    for i in range(n - 1, -1, -1):
        aft[i] = aft[i + 1, OUTSIDE]
        if begins[i]:
            on = np.logaddexp.reduce([s[x] + aft[where[x][1], :OUTSIDE] for x in begins[i]], axis=0)
            aft[i] = np.logaddexp(aft[i], np.logaddexp.reduce(step + on, axis=1))
    total = np.logaddexp.reduce(fore[n])
    p = np.exp(np.array([into[i] + s[x] + aft[j, :OUTSIDE] for x, (i, j) in enumerate(where)]) - total)
    by_own, by_step, value = -(p.T @ f), np.zeros_like(step), -total
    for i in range(n):
        if begins[i]:
            on = np.logaddexp.reduce([s[x] + aft[where[x][1], :OUTSIDE] for x in begins[i]], axis=0)
            by_step -= np.exp(fore[i][:, None] + step + on - total)
    last, state = 0, OUTSIDE
    for (i, j), x, k in sorted((where[x], x, k) for x, k in enumerate(gold) if k is not None):
        state = state if i == last and i else OUTSIDE
        value += s[x, k] + step[state, k]
        by_own[k] += f[x]
        by_step[state, k] += 1
        last, state = j, k
    return float(value), by_own, by_step


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 40, rate: float = 0.5, ridge: float = 1e-3, most_region: int = 2 * MOST_TOKENS) -> Weights:
    """Weights that make the spans of the examples likeliest, by gradient ascent on the conditional log-likelihood. Regions
    of over most_region tokens are left out of the sample (not of what is decoded)."""
    data: list[Region] = []
    for text, spans in examples:
        for tokens in regions(text):
            if len(tokens) > most_region:
                continue
            want = {(s, e): KINDS.index(k) for k, s, e in spans}
            c = _candidates(text, tokens)
            gold = [want.get((tokens[i][0], tokens[j - 1][1])) for i, j, _ in c]
            # an example's labels say nothing about other data near it
            if c and (not spans or any(k is not None for k in gold)):
                data.append((len(tokens), [(i, j) for i, j, _ in c], np.array([f for *_, f in c]), gold))
    own, step = np.zeros((len(KINDS), len(FEATURES))), np.zeros((OUTSIDE + 1, OUTSIDE))
    own[:, 0] = -2
    speed = [np.full_like(own, 1e-6), np.full_like(step, 1e-6)]
    for _ in range(epochs if data else 0):
        grads = [-ridge * own * len(data), -ridge * step * len(data)]
        for region in data:
            _, a, b = likelihood(region, (own, step))
            grads[0] += a
            grads[1] += b
        for w, v, g in zip((own, step), speed, grads, strict=True):
            v += g**2
            w += rate * g / np.sqrt(v)
    return own, step


def varied(text: str, span: Span) -> Iterator[tuple[str, list[Span]]]:
    """Ways of writing the same datum that the base patterns do not take, as labelled examples made from the corpus's own."""
    kind, a, b = span
    datum, around = text[a:b], (text[max(0, a - 40) : a], text[b : b + 40])
    forms = {"email": [datum.replace("@", " (at) "), datum.replace("@", " [at] ").replace(".", " [dot] ")], "phone": [re.sub(r"^\+[0-9]{1,3}[ .-]?", "", datum), re.sub(r"[() ]+", "-", datum.lstrip("+")).strip("-")], "card": [re.sub("(.{4})(?=.)", r"\1.", re.sub("[^0-9]", "", datum))], "ip": [datum.replace(".", "[.]")]}[kind]
    for form in [datum, *forms]:
        yield around[0] + form + around[1], [(kind, len(around[0]), len(around[0]) + len(form))]


def train(docs: DataFrame, text_col: str = "text", sample: int = 400, seed: int = 29, spans_a_text: int = 3, digits_a_text: int = 2) -> Weights:
    """Weights learned from at most sample documents that hold a base span and as many that hold only a digit, taken in
    the order of a hash, so that reruns agree; copies count once. Of a text, the first spans_a_text base spans and their
    rewritten forms are examples, or else the surroundings of its first digits_a_text digits. These bounds are of the
    training sample alone: they bound what reaches the driver and the time to fit."""
    datum = F.col("t").rlike("@|[0-9]{9}|[+][0-9]|[0-9][.][0-9]+[.][0-9]")
    have = docs.filter(F.col(text_col).rlike("[0-9]")).select(F.col(text_col).alias("t")).select("t", datum.alias("datum"), F.xxhash64(F.lit(seed), "t").alias("h"))

    @F.pandas_udf("array<struct<text:string,kind:string,a:int,b:int>>")
    def snippets(column):
        import pandas as pd

        return pd.Series([list(_examples(t, spans_a_text, digits_a_text)) for t in column])

    # the sample-th least hash of either part: Spark keeps so many a task
    rank = F.row_number().over(Window.partitionBy("datum").orderBy("h"))
    most = {r["datum"]: r["m"] for r in have.select("datum", "h").distinct().withColumn("r", rank).filter(F.col("r") <= sample).groupBy("datum").agg(F.max("h").alias("m")).collect()}
    few = have.filter(F.col("h") <= F.when(F.col("datum"), F.lit(most.get(True, 0))).otherwise(F.lit(most.get(False, 0)))).dropDuplicates(["h"])
    rows = few.select("datum", "h", F.posexplode(snippets("t")).alias("n", "e")).orderBy(F.col("datum").desc(), "h", "n").select("e.*").collect()
    return fit([(r["text"], [(r["kind"], r["a"], r["b"])] if r["kind"] else []) for r in rows])


def _examples(text: str, most_spans: int = 3, most_digits: int = 2) -> Iterator[tuple[str, str | None, int, int]]:
    """Short labelled examples of a text: the first base spans, each also rewritten, or else the first digits."""
    spans = base_spans(text)
    for s in spans[:most_spans]:
        for around, [(kind, a, b)] in varied(text, s):
            yield around, kind, a, b
    if not spans:
        for m in islice(_DIGIT.finditer(text), most_digits):
            yield text[max(0, m.start() - 40) : m.end() + 40], None, 0, 0


def find(text: str | None, weights: Weights, margin: float) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text: the field decides around the base spans, which it takes as given."""
    if not text:
        return [], []
    base = base_spans(text)
    by_start = sorted(base, key=lambda s: (s[1], s[2]))
    starts = [s[1] for s in by_start]
    reach = list(accumulate((s[2] for s in by_start), max))  # the farthest end up to each base span
    added: list[Span] = []
    for tokens in regions(text):
        lo, hi = tokens[0][0], tokens[-1][1]
        k = bisect_right(starts, lo)
        if k and reach[k - 1] >= hi:
            continue  # all of it lies in base spans
        near = by_start[bisect_right(reach, lo) : bisect_left(starts, hi)]
        added += decode(text, tokens, weights, margin, near)
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, text_col: str = "text", weights: Weights | None = None, margin: float = 1.0, out: str = "pii") -> DataFrame:
    """docs with a struct column: n_email, n_ip, n_card, n_phone (of base spans), base and spans, written as kind:start:end
    by start, then kind, joined by commas; positions are code points, ends exclusive.

    Base spans always stay. The field decides boundaries and kinds together over regions of the whole text; its spans
    count from margin of log-odds on. Null or empty text: no spans. Without weights, they are learned from docs; where
    docs has nothing to learn from, or no rows, only base spans come out. Very long texts: whole, region by region. Ties:
    fewer spans, then the kind listed first. Repeated rows get equal results. Other columns of docs pass unchanged; one
    named as out is replaced, in its place.
    """
    w = train(docs, text_col) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:string,spans:string>")
    def run(column):
        import pandas as pd

        rows = []
        for t in column:
            base, every = find(t, shared.value, margin)
            kinds = [s[0] for s in base]
            rows.append((*(kinds.count(k) for k in KINDS), written_spans(base), written_spans(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return docs.withColumn(out, run(F.col(text_col)))
