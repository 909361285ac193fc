"""Sequential clustering inside bounded groups: PCA, k-means, constrained merging, kit split.

The functions on arrays are plain numpy; ``per_group`` runs one of them for each game.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scalars import FLAT_STD, NORM_EPSILON

#: Fixed values of team clustering and of the kit split.
TEAM_COMPONENTS, MAX_MICRO, SILHOUETTE_MARGIN, SIZE_CORRELATION = 16, 4, 0.03, 0.5
VIVID_BAR, PLAIN_BAR, COHERENCE_BAR, MIN_SIDE, MIN_KIT_TRACKS, FLAT_KIT = 0.35, 0.22, 0.6, 0.15, 6, 1e-6
IDENTITY_COMPONENTS, IDENTITY_DISTANCE = 24, 0.35


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + NORM_EPSILON)


def principal_scores(x: np.ndarray, components: int) -> np.ndarray:
    """Scores on the leading principal components of the centred rows."""
    k = min(components, len(x) - 1, x.shape[1])
    if k < 1:
        return x.astype(float)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return u[:, :k] * s[:k]


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    if a.std() < FLAT_STD or b.std() < FLAT_STD:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


def team_reduction(x: np.ndarray, sizes: np.ndarray | None = None, components: int = TEAM_COMPONENTS) -> np.ndarray:
    """Unit-length scores without the components that follow crop size (at least two stay)."""
    if len(x) < 3:
        return unit_rows(x)
    scores = principal_scores(x, components)
    if sizes is not None and len(x) >= 4 and scores.shape[1] >= 3:
        follows = np.array([abs(correlation(scores[:, i], np.log(sizes + 1e-6))) for i in range(scores.shape[1])])
        keep = np.flatnonzero(follows < SIZE_CORRELATION)
        if len(keep) < 2:
            keep = np.sort(np.argsort(follows, kind="stable")[:2])
        scores = scores[:, keep]
    return unit_rows(scores)


def identity_reduction(x: np.ndarray, components: int = IDENTITY_COMPONENTS) -> np.ndarray:
    return unit_rows(principal_scores(x, components)) if len(x) >= 3 else unit_rows(x)


def k_means(x: np.ndarray, k: int, seed: int = 42, tries: int = 10, rounds: int = 300) -> np.ndarray:
    """Labels of the best of several k-means++ starts."""
    rng = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(tries):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres) ** 2).sum(-1).min(1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
            centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        for _ in range(rounds):
            own = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres, atol=1e-10):
                break
            centres = new
        cost = ((x - centres[own]) ** 2).sum()
        if cost < best - 1e-12:
            best, labels = cost, own
    return labels


def silhouette_score(x: np.ndarray, labels: np.ndarray) -> float:
    names = np.unique(labels)
    if not 2 <= len(names) < len(x):
        return float("nan")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    member = labels[:, None] == names
    sums, sizes = d @ member, member.sum(0)
    own = np.searchsorted(names, labels)
    at = np.arange(len(x))
    inside = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    outside = np.where(member, np.inf, sums / sizes).min(1)
    s = (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300)
    return float(np.where(sizes[own] == 1, 0.0, s).mean())


def merge_to_two(x: np.ndarray, micro: np.ndarray) -> np.ndarray:
    """Micro-clusters to two teams: the two largest are anchors, the others join the more similar one."""
    names, sizes = np.unique(micro, return_counts=True)
    if len(names) <= 2:
        return np.searchsorted(names, micro)
    anchors = names[np.lexsort((names, -sizes))[:2]]
    centre = {n: unit_rows(x[micro == n].mean(0)) for n in names.tolist()}
    a, b = (centre[n] for n in anchors.tolist())
    side = {n: 0 if n == anchors[0] or (n != anchors[1] and centre[n] @ a >= centre[n] @ b) else 1 for n in names.tolist()}
    return np.array([side[m] for m in micro.tolist()])


def team_clusters(x: np.ndarray, sizes: np.ndarray | None = None, max_micro: int = MAX_MICRO, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Team 0 or 1 of each track and the confidence.

    K micro-clusters are tried from 2 on; a larger K must beat the best silhouette so far by
    more than the margin.
    """
    n = len(x)
    if n < 2:
        return np.zeros(n, int), np.full(n, 0.5)
    if n == 2:
        return np.array([0, 1]), np.array([0.5, 0.5])
    reduced = team_reduction(x, sizes)
    best, chosen = -np.inf, None
    for k in range(2, min(max_micro, n - 1) + 1):
        labels = k_means(reduced, k, seed)
        score = silhouette_score(reduced, labels)
        if chosen is None or score > best + SILHOUETTE_MARGIN:
            best, chosen = score, labels
    teams = merge_to_two(reduced, chosen)
    centres = np.array([unit_rows(reduced[teams == t].mean(0)) if (teams == t).any() else np.zeros(reduced.shape[1]) for t in (0, 1)])
    similar = reduced @ centres.T
    own, other = similar[np.arange(n), teams], similar[np.arange(n), 1 - teams]
    confidence = np.clip((own - other + 2) / 4, 0, 1) if len(set(teams.tolist())) == 2 else np.full(n, 0.5)
    return teams, confidence


def kit_split(chroma: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Two kits by colourfulness, 0 the vivid one, with confidences; null unless the split is clear."""
    n = len(chroma)
    strength = np.linalg.norm(chroma, axis=1)
    if n < MIN_KIT_TRACKS or strength.std() < FLAT_KIT:
        return None
    labels = k_means(strength[:, None], 2)
    means = [strength[labels == k].mean() for k in (0, 1)]
    vivid = labels == int(np.argmax(means))
    centre = chroma[vivid].mean(0)
    coherence = np.linalg.norm(centre) / max(strength[vivid].mean(), 1e-12)
    balance = min(vivid.mean(), 1 - vivid.mean())
    clear = (
        max(means) >= VIVID_BAR
        and min(means) <= PLAIN_BAR
        and coherence >= COHERENCE_BAR
        and balance >= MIN_SIDE
        and min(vivid.sum(), n - vivid.sum()) >= 2
    )
    if not clear:
        return None
    to_vivid, to_plain = abs(strength - max(means)), abs(strength - min(means))
    own, other = np.where(vivid, to_vivid, to_plain), np.where(vivid, to_plain, to_vivid)
    return np.where(vivid, 0, 1), np.clip(other / np.maximum(own + other, 1e-12), 0, 1)


def conflict_matrix(first: np.ndarray, last: np.ndarray, min_gap: int = 0) -> np.ndarray:
    """Which spans cannot be one: they overlap, or are at most ``min_gap`` apart."""
    out = np.maximum(first[:, None], first) <= np.minimum(last[:, None], last) + min_gap
    np.fill_diagonal(out, False)
    return out


def constrained_merge(
    points: np.ndarray, cannot_link: np.ndarray, target: int | None = None, threshold: float = IDENTITY_DISTANCE
) -> tuple[np.ndarray, int]:
    """Average-linkage merging of unit vectors under cannot-link pairs; labels and vetoed steps.

    Each step merges the closest pair of clusters without a conflict between members, and
    counts as vetoed if the closest pair of all had one, also where merging then ends: at
    ``target`` clusters, or without a target once the best distance exceeds ``threshold``, or
    when every pair conflicts.
    Linkage follows the size-weighted update of averages, so a step costs one pass.
    """
    n = len(points)
    d = np.clip(1 - points @ points.T, 0, 2)
    np.fill_diagonal(d, np.inf)
    veto = cannot_link.copy()
    size = np.ones(n)
    live = np.ones(n, bool)
    member = np.arange(n)
    blocked = 0
    upper = np.triu(np.ones((n, n), bool), 1)
    while live.sum() > (target or 1):
        usable = upper & live[:, None] & live
        open_ = np.where(usable & ~veto, d, np.inf)
        at = int(open_.argmin()) if n else 0
        i, j = divmod(at, n)
        best = open_[i, j] if n else np.inf
        every = np.where(usable, d, np.inf)
        blocked += bool(usable.any() and veto.flat[every.argmin()])
        if not np.isfinite(best) or (target is None and best > threshold):
            break
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        veto[i] |= veto[j]
        veto[:, i] |= veto[:, j]
        size[i] += size[j]
        live[j] = False
        member[member == j] = i
    _, first, inverse = np.unique(member, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    return rank[inverse], blocked


def identities(
    x: np.ndarray, first: np.ndarray, last: np.ndarray, target: int | None = None, threshold: float = IDENTITY_DISTANCE, min_gap: int = 0
) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Identity, confidence, vetoed steps and silhouette of the tracks of one clip."""
    if not len(x):
        return np.zeros(0, int), np.zeros(0), 0, float("nan")
    reduced = identity_reduction(x)
    labels, blocked = constrained_merge(reduced, conflict_matrix(first, last, min_gap), target, threshold)
    k = labels.max() + 1
    centres = np.array([unit_rows(reduced[labels == c].mean(0)) for c in range(k)])
    similar = reduced @ centres.T
    at = np.arange(len(x))
    own = similar[at, labels].copy()
    similar[at, labels] = -np.inf
    lead = own - similar.max(1)
    single = np.bincount(labels)[labels] == 1
    confidence = np.where(single | (k == 1), 0.5, np.clip(np.where(np.isfinite(lead), lead, 0) * 0.5 + 0.5, 0, 1))
    return labels, confidence, blocked, silhouette_score(reduced, labels)


def cross_segment(x: np.ndarray, segment: np.ndarray, roster: int | None = None, threshold: float = IDENTITY_DISTANCE) -> tuple[np.ndarray, int]:
    """Game players from identities of segments; two of one segment are never one player."""
    if not len(x):
        return np.zeros(0, int), 0
    conflict = segment[:, None] == segment
    np.fill_diagonal(conflict, False)
    return constrained_merge(identity_reduction(x), conflict, roster, threshold)


def per_group(df: DataFrame, keys: list[str], order: list[str], schema: str, solve: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run ``solve`` on each group, its rows in a fixed order. Groups are the tracks of one game."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return solve(rows.sort_values(order, kind="stable", ignore_index=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def by_color(labels: np.ndarray, hsv: np.ndarray) -> np.ndarray:
    """Labels renumbered: most saturated first, then brightest, then smallest hue, by medians of their tracks."""
    names = np.unique(labels)
    medians = np.array([np.median(hsv[labels == n], axis=0) for n in names.tolist()]).reshape(-1, 3)
    order = np.lexsort((names, medians[:, 0], -medians[:, 2], -medians[:, 1]))
    rank = np.empty(len(names), int)
    rank[order] = np.arange(len(names))
    return rank[np.searchsorted(names, labels)]


def assign_teams(
    tracks: DataFrame, keys: list[str], vector: str = "embedding", size: str | None = None, chroma: str | None = None, hsv: str | None = None
) -> DataFrame:
    """``track_id, team, team_conf`` per track: the kit colours if they split clearly, else the vectors.

    With ``hsv`` (hue, saturation, value of a track's torso) team 0 is the more saturated one;
    without it the numbers of teams are arbitrary.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tracks.select(*keys, "track_id").schema)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        split = kit_split(np.stack(rows[chroma].to_numpy()).astype(float)) if chroma else None
        if split is None:
            sizes = rows[size].to_numpy(float) if size else None
            split = team_clusters(np.stack(rows[vector].to_numpy()).astype(float), sizes)
        teams = by_color(split[0], np.stack(rows[hsv].to_numpy()).astype(float)) if hsv else split[0]
        return rows[[*keys, "track_id"]].assign(team=teams.astype("int32"), team_conf=split[1])

    return per_group(tracks, keys, ["track_id"], f"{fields}, team int, team_conf double", solve)


def assign_identities(
    tracks: DataFrame, keys: list[str], target: int | None = None, threshold: float = IDENTITY_DISTANCE, min_gap: int = 0, vector: str = "embedding"
) -> DataFrame:
    """``track_id, player, player_conf, blocked, silhouette`` per track."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tracks.select(*keys, "track_id").schema)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows[vector].to_numpy()).astype(float)
        labels, confidence, blocked, score = identities(x, rows["first_frame"].to_numpy(), rows["last_frame"].to_numpy(), target, threshold, min_gap)
        return rows[[*keys, "track_id"]].assign(player=labels.astype("int64"), player_conf=confidence, blocked=np.int64(blocked), silhouette=score)

    return per_group(tracks, keys, ["track_id"], f"{fields}, player long, player_conf double, blocked long, silhouette double", solve)


def merge_segment_identities(
    found: DataFrame, keys: list[str], roster: int | None = None, threshold: float = IDENTITY_DISTANCE, vector: str = "centroid"
) -> DataFrame:
    """``segment, local_id, player`` per segment identity, numbered by first appearance."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*keys, "segment", "local_id").schema)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows[vector].to_numpy()).astype(float)
        labels, _ = cross_segment(x, rows["segment"].to_numpy(), roster, threshold)
        return rows[[*keys, "segment", "local_id"]].assign(player=labels.astype("int64"))

    return per_group(found, keys, ["segment", "local_id"], f"{fields}, player long", solve)


class ColorTeams:
    """Two teams by torso colour: a brightness split until enough samples came, then frozen centres."""

    def __init__(self, min_samples: int = 8):
        self.min_samples, self.samples, self.centres = min_samples, [], None

    def predict(self, colors: np.ndarray) -> np.ndarray:
        colors = np.asarray(colors, float).reshape(-1, 3)
        if self.centres is None:
            self.samples.extend(colors.tolist())
            if len(self.samples) < self.min_samples:
                bright = colors.mean(1)
                return (bright > bright.mean()).astype(int) if len(bright) else np.zeros(0, int)
            x = np.array(self.samples)
            labels = k_means(x, 2)
            self.centres = np.array([x[labels == k].mean(0) if (labels == k).any() else x.mean(0) for k in (0, 1)])
        return ((colors[:, None] - self.centres) ** 2).sum(-1).argmin(1)
