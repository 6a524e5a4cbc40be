"""Monotonic alignments by dynamic programming, one group of two sequences at a time.

The tables are sequential by nature, so they run in grouped pandas functions; the exchange is by the group's key, and a
group is as long as one case. Token lists that share a row are aligned row by row. Ties are decided as documented with each function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lcs(planned: list[str], gold: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; on a tie a planned item is skipped first."""
    n, m = len(planned), len(gold)
    best = np.zeros((n + 1, m + 1), np.int32)
    ids = {t: k for k, t in enumerate(dict.fromkeys(gold))}
    other = np.array([ids[t] for t in gold], np.int64)
    for i in range(n - 1, -1, -1):
        row = np.where(other == ids.get(planned[i], -1), best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :m] = np.maximum.accumulate(row[::-1])[::-1]
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if planned[i] == gold[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _together(spans: list[tuple[float, float, int, int]]) -> Iterator[tuple[list[int], list[int]]]:
    """Numbers of both sides' spans (start, end, side, number) in groups that no span reaches across, in order."""
    sides, reach = ([], []), -np.inf
    for start, end, side, i in sorted(spans):
        if start > reach and (sides[0] or sides[1]):
            yield sides
            sides = ([], [])
        reach = max(reach, end)
        sides[side].append(i)
    if sides[0] or sides[1]:
        yield sides


def match_events(a: list[tuple[float, str, str]], b: list[tuple[float, str, str]], limit: float) -> list[tuple[int, int]]:
    """Monotonic matches of (time, kind, word) sequences in the order of time: as many as possible, then as many of the same
    word, then the least total distance; only equal kinds within the limit. On a tie the item of a is skipped first. The
    sequences are cut where no item is within the limit of a later one, so a table is as large as a crowd, not a case."""
    spans = [(t, t + limit, side, i) for side, events in enumerate((a, b)) for i, (t, *_) in enumerate(events)]
    return [(x[i], y[j]) for x, y in _together(spans) if x and y for i, j in _match([a[i] for i in x], [b[j] for j in y], limit)]


def _match(a: list[tuple[float, str, str]], b: list[tuple[float, str, str]], limit: float) -> list[tuple[int, int]]:
    """match_events of one crowd. A row of the table is made at once: taking or leaving each item of b, and then the best of
    what is at or after a place, which a running maximum from the right gives."""
    n, m = len(a), len(b)
    kinds = {k: i for i, k in enumerate(dict.fromkeys(k for _, k, _ in a + b))}
    t, kind, word = np.array([e[0] for e in b]), np.array([kinds[e[1]] for e in b]), [e[2] for e in b]
    # Values are compared as (matches, matches of words, -distance).
    best, take = [[(0, 0, 0.0)] * (m + 1)], []
    for i in range(n - 1, -1, -1):
        below, row, taken = best[-1], list(best[-1]), np.zeros(m, np.int8)
        d = np.abs(t - a[i][0])
        for j in np.flatnonzero((kind == kinds[a[i][1]]) & (d <= limit))[::-1].tolist():
            k, w, e = below[j + 1]
            got = (k + 1, w + (a[i][2] == word[j]), e - float(d[j]))
            if got > below[j]:
                row[j], taken[j] = got, 1
        for j in range(m - 1, -1, -1):
            # A match must be better than leaving the item of b out, and that better than leaving a's.
            if row[j + 1] > row[j] or taken[j] == 1 and row[j + 1] == row[j]:
                row[j], taken[j] = row[j + 1], 2
        best.append(row)
        take.append(taken)
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        step = take[n - 1 - i][j]
        if step == 1:
            pairs.append((i, j))
        i, j = i + (step != 2), j + (step != 0)
    return pairs


def align_spans(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> list[tuple[int, int, float]]:
    """Pairs (i, j, IoU), or -1 for a missing partner, of spans in order: 1 for a missing or an extra span, 1 - IoU for a
    match of spans that overlap. A match wins a tie, then missing (a without partner) before extra. The sides are cut where
    no span reaches across, as spans on two sides of such a place never match."""
    spans = [(s, max(s, e), side, i) for side, rows in enumerate((a, b)) for i, (s, e) in enumerate(rows)]
    return [(x[i] if i >= 0 else -1, y[j] if j >= 0 else -1, share) for x, y in _together(spans) for i, j, share in _align([a[i] for i in x], [b[j] for j in y])]


def _align(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> list[tuple[int, int, float]]:
    """align_spans of one crowd."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1))
    cost[:, m], cost[n, :] = np.arange(n, -1, -1), np.arange(m, -1, -1)
    (s, e), (u, v) = (np.array(x, float).reshape(-1, 2).T for x in (a, b))
    both = np.maximum(0.0, np.minimum(e[:, None], v) - np.maximum(s[:, None], u))
    union = (e - s)[:, None] + (v - u) - both
    share = np.divide(both, union, out=np.zeros((n, m)), where=union > 0)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            take = cost[i + 1, j + 1] + 1 - share[i, j] if both[i, j] > 0 else np.inf
            cost[i, j] = min(take, cost[i + 1, j] + 1, cost[i, j + 1] + 1)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and share[i, j] > 0 and cost[i, j] == cost[i + 1, j + 1] + 1 - share[i, j]:
            out.append((i, j, float(share[i, j])))
            i, j = i + 1, j + 1
        elif i < n and cost[i, j] == cost[i + 1, j] + 1:
            out.append((i, -1, 0.0))
            i += 1
        else:
            out.append((-1, j, 0.0))
            j += 1
    return out


def _advance(stay: np.ndarray, go: np.ndarray | None) -> np.ndarray:
    return np.log1p(-np.exp(stay)) if go is None else np.asarray(go, float)


def viterbi(scores: np.ndarray, stay: np.ndarray, go: np.ndarray | None = None) -> list[int]:
    """The best path of states, frame by frame, that begins in state 0 and stays or advances by one; stay: log prior of
    staying in a state, 1 minus it for advancing. Staying wins a tie. The path ends in the best state reached. go: the log
    prior of advancing where it is known; the one made of stay may be off by its last bit, which decides between paths that
    are equally good."""
    frames, states = scores.shape
    go = _advance(stay, go)
    best = np.full(states, -np.inf)
    best[0] = scores[0, 0]
    back = np.zeros((frames, states), np.int8)
    for t in range(1, frames):
        held = best + stay
        moved = np.concatenate([[-np.inf], best[:-1] + go[:-1]])
        back[t] = moved > held
        best = np.maximum(held, moved) + scores[t]
    at = int(np.argmax(best))
    path = [at]
    for t in range(frames - 1, 0, -1):
        at -= back[t, at]
        path.append(int(at))
    return path[::-1]


# Fixed values of the hold: frames beyond the lag that a decision may wait after a comma, the seconds a token that no frame
# was left for gets at the end.
HOLD_FRAMES, TAIL_SECONDS = 3, 0.010


class FixedLag:
    """Decoding frame by frame: frame t is decided by what is known at t + lag, never revised, and never goes back or ahead by
    more than one state.

    pause[s]: state s is a comma's pause. A frame that would be the first one past such a pause, without a quiet frame seen
    since, waits up to HOLD_FRAMES more; with a quiet one by then the frame is the pause's, else the first decision stands
    and this pause is settled. `kept` is all that the future depends on, as plain lists, so a stream can store it."""

    def __init__(self, stay: np.ndarray, lag: int, pause: np.ndarray | None = None, kept: dict | None = None, go: np.ndarray | None = None):
        self.stay, self.go, self.lag = stay, _advance(stay, go), lag
        self.pause = np.zeros(len(stay), bool) if pause is None else pause
        kept = kept or {"best": [], "back": [], "quiet": [], "last": -1, "held": -1, "settled": -1}
        self.best, self.back, self.quiet = np.array(kept["best"], float), [np.array(b, np.int8) for b in kept["back"]], list(kept["quiet"])
        self.last, self.held, self.settled = kept["last"], kept["held"], kept["settled"]

    @property
    def kept(self) -> dict:
        """back and quiet: of the frames that aren't decided yet; last: the state decided last (-1: none); held: the state
        that the next frame waits with (-1: it doesn't); settled: the pause that was passed without a quiet frame."""
        return {"best": self.best.tolist(), "back": [b.tolist() for b in self.back], "quiet": self.quiet, "last": self.last, "held": self.held, "settled": self.settled}

    def _path(self) -> list[int]:
        """The best path through the frames that aren't decided yet."""
        at = int(np.argmax(self.best))
        path = [at]
        for back in self.back[:0:-1]:
            at -= int(back[at])
            path.append(at)
        return path[::-1]

    def _decide(self, state: int) -> int:
        self.last = state if self.last < 0 else min(max(state, self.last), self.last + 1)
        self.back, self.quiet, self.held = self.back[1:], self.quiet[1:], -1
        return self.last

    def push(self, scores: np.ndarray, quiet: bool = False) -> list[int]:
        """The states of the frames that this frame decides, oldest first."""
        if not len(self.best):
            self.best = np.where(np.arange(len(scores)) == 0, scores, -np.inf)
            back = np.zeros(len(scores), np.int8)
        else:
            held, moved = self.best + self.stay, np.concatenate([[-np.inf], self.best[:-1] + self.go[:-1]])
            back = (moved > held).astype(np.int8)
            self.best = np.maximum(held, moved) + scores
        self.back.append(back)
        self.quiet.append(bool(quiet))
        out = []
        while len(self.back) > self.lag:
            state = self._path()[0]
            state = state if self.last < 0 else min(max(state, self.last), self.last + 1)
            before = state - 1
            open_ = state > 0 and self.pause[before] and not self.pause[state] and before != self.settled and self.last <= before
            waits = len(self.back) - self.lag <= HOLD_FRAMES
            if self.held >= 0 or open_:
                if any(self.quiet):
                    state = max(before, self.last) if open_ else state
                elif waits:
                    self.held = state if self.held < 0 else self.held
                    break
                else:
                    state = self.held if self.held >= 0 else state
                    self.settled = state - 1
            out.append(self._decide(state))
        return out

    def finish(self, complete: bool = False) -> tuple[list[int], list[int]]:
        """The states of the frames that are left, by the best path; and, if complete, the states that no frame was left
        for. complete: where that path ends before the last state and has frames enough, the missing states are dealt out
        over the frames evenly."""
        if not len(self.best):
            return [], []
        path, states = self._path() if self.back else [], len(self.stay)
        first = max(self.last, 0)
        missing, frames = states - 1 - first, len(path)
        if complete and path and path[-1] < states - 1 and missing <= frames:
            path = [first + (k + 1) * missing // frames for k in range(frames)]
        out = [self._decide(s) for s in path]
        return out, list(range(self.last + 1, states)) if complete else []


def fixed_lag(scores: np.ndarray, stay: np.ndarray, lag: int, pause: np.ndarray | None = None, quiet: np.ndarray | None = None, complete: bool = False, go: np.ndarray | None = None) -> list[int]:
    """All frames through FixedLag; with complete, the states without a frame follow those of the frames."""
    machine = FixedLag(stay, lag, pause, go=go)
    done = [s for t, row in enumerate(scores) for s in machine.push(row, quiet is not None and bool(quiet[t]))]
    rest, tail = machine.finish(complete)
    return done + rest + tail


def align_tokens(pairs: DataFrame) -> DataFrame:
    """The other columns of pairs, then planned and gold places (from 0) of matched tokens, a row a match. planned and gold
    of pairs are lists of tokens; a null list matches nothing."""
    keys = [f for f in pairs.schema.fields if f.name not in ("planned", "gold")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, planned, gold = [], [], []
            for row, (x, y) in enumerate(zip(b.column("planned"), b.column("gold"), strict=True)):
                for i, j in lcs(x.as_py() or [], y.as_py() or []):
                    at.append(row)
                    planned.append(i)
                    gold.append(j)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name).take(rows) for f in keys), pa.array(planned, pa.int32()), pa.array(gold, pa.int32())],
                names=[*(f.name for f in keys), "planned", "gold"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return pairs.mapInArrow(run, f"{kinds}, planned int, gold int")


def align_events(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """case_id, a_id, b_id, error of matched events. Inputs: (case_id, id, t, kind, word)."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"case_id": [], "a_id": [], "b_id": [], "error": []})
        x, y = x.sort_values(["t", "id"]), y.sort_values(["t", "id"])
        rows = lambda d: list(zip(d["t"].astype(float), d["kind"], d["word"], strict=True))
        pairs = match_events(rows(x), rows(y), limit)
        case = x["case_id"].iloc[0]
        return pd.DataFrame({"case_id": [case] * len(pairs), "a_id": [x["id"].iloc[i] for i, _ in pairs], "b_id": [y["id"].iloc[j] for _, j in pairs], "error": [float(y["t"].iloc[j] - x["t"].iloc[i]) for i, j in pairs]})

    return a.groupBy("case_id").cogroup(b.groupBy("case_id")).applyInPandas(run, "case_id long, a_id long, b_id long, error double")


def align_regions(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """case_id, gold and predicted numbers (-1: none), iou. Inputs: (case_id, region, start, end)."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        sort = lambda d: d.sort_values("region") if len(d) else d
        x, y = sort(x), sort(y)
        spans = lambda d: list(zip(d["start"].astype(float), d["end"].astype(float), strict=True)) if len(d) else []
        out = align_spans(spans(x), spans(y))
        case = (x if len(x) else y)["case_id"].iloc[0]
        at = lambda d, i: int(d["region"].iloc[i]) if i >= 0 else -1
        return pd.DataFrame({"case_id": [case] * len(out), "gold": [at(x, i) for i, _, _ in out], "predicted": [at(y, j) for _, j, _ in out], "iou": [s for _, _, s in out]})

    return gold.groupBy("case_id").cogroup(predicted.groupBy("case_id")).applyInPandas(run, "case_id long, gold int, predicted int, iou double")


def decode_cases(frames: DataFrame, states: int, lag: int) -> DataFrame:
    """case_id, frame, offline, committed: both decodings of left-to-right states from frames (case_id, frame, value).
    A state's score is how near its level, evenly spaced over the case's range, is to the value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        scores = _level_scores(pdf["value"].to_numpy(float), states)
        stay, go = np.full(states, np.log(0.8)), np.full(states, np.log(0.2))
        return pd.DataFrame({"case_id": pdf["case_id"], "frame": pdf["frame"], "offline": viterbi(scores, stay, go), "committed": fixed_lag(scores, stay, lag, go=go)})

    return frames.groupBy("case_id").applyInPandas(run, "case_id long, frame long, offline int, committed int")


def forward(scores: np.ndarray, lengths: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Log likelihoods of cases (case, frame, state; each of its own length, filled up at the end) over all paths from the first
    state to the last that stay or advance by one; -inf where there is none. All cases of a batch take a step together."""
    go = np.log1p(-np.exp(stay))
    total = np.full((len(scores), scores.shape[2]), -np.inf)
    total[:, 0] = scores[:, 0, 0]
    ends = np.where(lengths == 1, total[:, -1], -np.inf)
    for t in range(1, scores.shape[1]):
        moved = np.concatenate([np.full((len(total), 1), -np.inf), total[:, :-1] + go[:-1]], axis=1)
        total = np.logaddexp(total + stay, moved) + scores[:, t]
        ends = np.where(lengths == t + 1, total[:, -1], ends)
    return ends


def forward_cases(frames: DataFrame, states: int) -> DataFrame:
    """case_id, frames, log_likelihood (null where no path reaches the last state) from frames (case_id, frame, value), with the
    scores and priors of decode_cases. A case's values are one list, and the cases of a batch, by similar length, are one
    array, so no Python call is made for each case."""
    kind = frames.schema["case_id"].dataType.simpleString()
    rows = frames.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda r: r["value"]).alias("values"))
    stay = np.full(states, np.log(0.8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.array(v.as_py(), float) for v in b.column("values")]
            lengths = np.array([len(v) for v in values])
            found = np.full(len(values), -np.inf)
            order = np.argsort(lengths, kind="stable")
            at = 0
            while at < len(order):
                # As many cases as fill some eight million cells.
                end = at + 1
                while end < len(order) and (end + 1 - at) * lengths[order[end]] * states <= 1 << 23:
                    end += 1
                group = order[at:end]
                scores = np.zeros((len(group), lengths[group].max(), states))
                for k, i in enumerate(group):
                    scores[k, : lengths[i]] = _level_scores(values[i], states)
                found[group] = forward(scores, lengths[group], stay)
                at = end
            likely = pa.array([x if np.isfinite(x) else None for x in found.tolist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("case_id"), pa.array(lengths, pa.int64()), likely], names=["case_id", "frames", "log_likelihood"])

    return rows.mapInArrow(run, f"case_id {kind}, frames long, log_likelihood double")


# Fixed values of the lattice with dwell: weight of speech occupancy, its bounds, a frame's seconds, bounds of the chance to
# advance, frames a token should last at least by its prior, and at most, and what each missing frame costs.
OCCUPANCY_WEIGHT, OCCUPANCY_BOUNDS = 1.75, (0.02, 0.98)
FRAME_SECONDS, LEAST_PRIOR, ADVANCE_BOUNDS = 0.010, 0.020, (0.02, 0.80)
LEAST_FRAMES_A_SECOND, LEAST_FRAMES, MOST_FRAMES_A_SECOND, MOST_FRAMES = 50.0, (2, 8), 300.0, (6, 30)
SENTENCE_FRAMES, SENTENCE_COST, TOKEN_COST = 8, 0.75, 0.50


def dwell_path(scores: np.ndarray, speech: np.ndarray, prior: np.ndarray, silent: np.ndarray, sentence: np.ndarray) -> list[int]:
    """Tokens frame by frame, left to right from the first to the last, which the path is made to end in. scores: log
    probabilities by frame and token; speech: the chance of speech by frame, for tokens that aren't silent; prior: a
    token's usual seconds. A token is left early at a cost by frame, not before its second frame, and held no longer than
    its limit; silent tokens have no such limits but a sentence's end has its own cost. Dwell is that of each token's best
    path, and staying wins a tie. With fewer frames than tokens the path begins later than at the first one; where no path
    reaches the last token, as a token before it never lasts, the last token is all there is."""
    frames, tokens = scores.shape
    heard = np.clip(speech, *OCCUPANCY_BOUNDS)[:, None]
    emission = scores + OCCUPANCY_WEIGHT * np.log(np.where(silent[None, :], 1 - heard, heard))
    advance = np.clip(FRAME_SECONDS / np.maximum(prior, LEAST_PRIOR), *ADVANCE_BOUNDS)
    least = np.where(sentence, SENTENCE_FRAMES, np.where(silent, 1, np.clip(np.ceil(prior * LEAST_FRAMES_A_SECOND), *LEAST_FRAMES)))
    most = np.where(silent, np.inf, np.clip(np.ceil(prior * MOST_FRAMES_A_SECOND), *MOST_FRAMES))
    cost = np.where(sentence, SENTENCE_COST, TOKEN_COST)
    stay, go = np.log(1 - advance), np.log(advance)
    best, dwell = np.full(tokens, -np.inf), np.zeros(tokens, np.int64)
    best[0], dwell[0] = scores[0, 0] + OCCUPANCY_WEIGHT * np.log(1 - heard[0, 0]), 1
    came = np.zeros((frames, tokens), bool)
    for t in range(1, frames):
        held = np.where(dwell < most, best + stay, -np.inf)
        left = np.where(silent | (dwell >= 2), best + go - np.maximum(least - dwell, 0) * cost, -np.inf)
        moved = np.concatenate([[-np.inf], left[:-1]])
        came[t] = moved > held
        best, dwell = np.maximum(held, moved) + emission[t], np.where(came[t], 1, dwell + 1)
    at, path = tokens - 1, []
    for t in range(frames - 1, -1, -1):
        path.append(at)
        at -= int(came[t, at])
    return path[::-1]


def decode_dwell(frames: DataFrame, prior: list[float], silent: list[bool], sentence: list[bool]) -> DataFrame:
    """case_id, frame, token of frames (case_id, frame, value, speech): a token's score is how near its level, evenly spaced
    over the case's range, is to the value, and speech the chance of speech."""
    p, q, r = np.array(prior, float), np.array(silent, bool), np.array(sentence, bool)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        scores = _level_scores(pdf["value"].to_numpy(float), len(p))
        return pd.DataFrame({"case_id": pdf["case_id"], "frame": pdf["frame"], "token": dwell_path(scores, pdf["speech"].to_numpy(float), p, q, r)})

    return frames.groupBy("case_id").applyInPandas(run, "case_id long, frame long, token int")


def _level_scores(v: np.ndarray, states: int) -> np.ndarray:
    return level_scores(v, v.min(), v.max(), states)


def level_scores(v: np.ndarray, low: float | np.ndarray, high: float | np.ndarray, states: int) -> np.ndarray:
    """Log-softmax of how near each of evenly spaced levels is to the values; low and high may be one for each value.

    Levels are that far apart that paths with the same number of frames above and below are equally good, so the last bit
    decides: every step is rounded in the order of the SQL, with the C library's exp and ln, which numpy replaces on some
    processors."""
    low, high = (np.broadcast_to(np.asarray(x, float), v.shape)[:, None] for x in (low, high))
    scores = -np.abs(v[:, None] - (low + (high - low) * np.arange(states) / max(states - 1, 1))) / (high - low + 1e-9)
    shifted = scores - scores.max(axis=1, keepdims=True)
    total = np.zeros(len(v))
    for e in _plain(pc.exp, shifted.T):
        total = total + e
    return shifted - _plain(pc.ln, np.maximum(total, 1e-12))[:, None]


def _plain(f: Callable, x: np.ndarray) -> np.ndarray:
    """An Arrow function of an array of any shape."""
    return f(pa.array(x.ravel())).to_numpy(zero_copy_only=False).reshape(x.shape)
