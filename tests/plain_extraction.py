"""The label pass on arrays, region after region and plane after plane: what the joins must give."""

import math

import numpy as np

from facetframe.operators.kernels import huber_plane


class Mesh:
    """Arrays of one scene from shaped face rows and adjacent pairs."""

    def __init__(self, rows, near):
        rows = sorted(rows, key=lambda r: r["fid"])
        self.fid = [r["fid"] for r in rows]
        at = {f: k for k, f in enumerate(self.fid)}
        self.label = np.array([r["label_int"] for r in rows])
        self.area = np.array([r["area"] for r in rows])
        self.normal = np.array([[r["nx"], r["ny"], r["nz"]] for r in rows])
        self.middle = np.array([[r["cx"], r["cy"], r["cz"]] for r in rows])
        self.corner = np.array([[[r[f"{a}{k}"] for a in "xyz"] for k in range(3)] for r in rows])
        self.vertex = np.array([[r["v0"], r["v1"], r["v2"]] for r in rows])
        self.near = [[] for _ in rows]
        for a, b in near:
            self.near[at[a]].append(at[b])

    def points(self, faces):
        faces = sorted(faces)
        first = np.unique(self.vertex[faces].reshape(-1), return_index=True)[1]
        return self.corner[faces].reshape(-1, 3)[first]




def sweep(m, label_faces, n, d, degrees, distance, share):
    far = np.abs(m.corner @ n + d) <= distance
    turned = m.normal @ n
    return {f for f in label_faces if turned[f] > 0 and turned[f] >= math.cos(math.radians(degrees)) and far[f].sum() >= math.ceil(3 * share)}


def agreeing(m, swept, least):
    return {f for f in swept if sum(g in swept for g in m.near[f]) >= least}


def seed_run(m, faces, n, d, seeds, gap):
    order = sorted(faces, key=lambda f: (m.middle[f] @ n + d, m.fid[f]))
    runs, last = [], None
    for f in order:
        t = m.middle[f] @ n + d
        if last is None or t - last > gap:
            runs.append(set())
        runs[-1].add(f)
        last = t
    return max(runs, key=lambda run: len(run & seeds)) if runs else set()


def ok(m, faces, q, basis):
    """(n, d) if the faces' plane passes the gates; ``basis`` gives the two directions across a normal."""
    faces = sorted(faces)
    p = m.points(faces)
    if len(p) < 3:
        return None
    n, d = huber_plane(p[np.lexsort(p.T[::-1])])
    t = p @ n + d
    turned = np.degrees(np.arccos(np.minimum(1.0, np.abs(m.normal[faces] @ n))))
    e1, e2 = basis(n)
    w1, w2 = np.ptp(p @ e1), np.ptp(p @ e2)
    passes = (np.percentile(np.abs(t), 95) <= q.p95, (np.abs(t) <= q.inlier_distance).mean() >= q.inlier_frac, np.ptp(t) <= q.thickness, np.percentile(turned, 95) <= q.degrees, min(w1, w2) >= q.width, m.area[faces].sum() / max(w1 * w2, 1e-9) >= q.fill)
    return (n, d) if all(passes) else None


def regions(m, grown, p, basis):
    """``grown``: label to lists of faces. Sequential over each label's regions: label to [(number, faces, (n, d))]."""
    g, out = p.growth, {}
    for label, regs in grown.items():
        own = [k for k in range(len(m.fid)) if m.label[k] == label]
        if len(own) < max(20, g.least_faces // 2):
            continue
        order = sorted(range(len(regs)), key=lambda k: (-m.area[list(regs[k])].sum(), k))
        taken, found = set(), []
        for number, k in enumerate(order, 1):
            reg = set(regs[k])
            if reg <= taken or (plane := ok(m, reg, p.quality, basis)) is None:
                continue
            curr, before = set(reg), 0
            for _ in range(max(1, p.em_rounds)):
                swept = agreeing(m, sweep(m, [f for f in own if f not in taken], *plane, g.sweep_degrees, g.sweep_distance, g.sweep_share), p.consensus)
                union = curr | swept
                if p.clusters:
                    union = seed_run(m, union, *plane, reg, p.gap)
                better = ok(m, union, p.quality, basis)
                if better is None:
                    break
                plane = better
                more = 0.0 if before == 0 else (len(union) - before) / before
                curr = union
                if more < p.em_growth:
                    break
                before = len(union)
            if len(curr) >= g.least_faces and m.area[list(curr)].sum() >= g.least_area:
                taken |= curr
                found.append((number, curr, plane))
        out[label] = found
    return out


def merged(m, patches, own, degrees, distance, sweep_degrees, sweep_distance, sweep_share, q, basis):
    """Rounds of conditional merges over one label's {number: (faces, plane)}."""
    from dataclasses import replace

    q, fresh = replace(q, inlier_distance=sweep_distance), set(patches)
    while True:
        passed = {}
        for a in sorted(patches):
            for b in sorted(patches):
                if a >= b or not ({a, b} & fresh):
                    continue
                (fa, (na, da)), (fb, (nb, db)) = patches[a], patches[b]
                if abs(na @ nb) < math.cos(math.radians(degrees)):
                    continue
                far = max(np.percentile(np.abs(m.points(fa) @ nb + db), 85), np.percentile(np.abs(m.points(fb) @ na + da), 85))
                if far > distance or (plane := ok(m, fa | fb, q, basis)) is None:
                    continue
                union = fa | fb | agreeing(m, sweep(m, own, *plane, sweep_degrees, sweep_distance, sweep_share), 2)
                if (plane := ok(m, union, q, basis)) is not None:
                    passed[a, b] = (union, plane)
        least = {}
        for pair in sorted(passed):
            for end in pair:
                least.setdefault(end, pair)
        chosen = [pair for pair in passed if least[pair[0]] == least[pair[1]] == pair]
        if not chosen:
            return patches
        fresh = set()
        for a, b in chosen:
            del patches[b]
            patches[a] = passed[a, b]
            fresh.add(a)


def settled(m, patches):
    size = {k: round(float(m.area[list(f)].sum()), 9) for k, (f, _) in patches.items()}
    best = {}
    for k in sorted(patches, key=lambda k: (-size[k], k)):
        for f in patches[k][0]:
            best.setdefault(f, k)
    out = {}
    for f, k in best.items():
        out.setdefault(k, set()).add(f)
    return {k: (f, patches[k][1]) for k, f in out.items()}


def saturated(m, patches, own, p, basis, rounds):
    for _ in range(rounds):
        start = {k: set(f) for k, (f, _) in patches.items()}
        wide = {}
        for k, (faces, plane) in patches.items():
            union = faces | agreeing(m, sweep(m, own, *plane, p.saturation_degrees, p.saturation_distance, p.saturation_share), 1)
            better = ok(m, union, p.saturation, basis)
            wide[k] = (faces, plane) if better is None else (union, better)
        light = max(0.02, 0.6 * p.saturation_distance)
        patches = merged(m, settled(m, wide), own, 10.0, light, p.saturation_degrees, p.saturation_distance, p.saturation_share, p.saturation, basis)
        patches = settled(m, patches)
        if {k: f for k, (f, _) in patches.items()} == start:
            break
    return patches


def extract(m, grown, p, basis):
    """{face: (label, number)} after the whole pass."""
    g, out = p.growth, {}
    for label, found in regions(m, grown, p, basis).items():
        own = [k for k in range(len(m.fid)) if m.label[k] == label]
        patches = {k: (faces, plane) for k, faces, plane in found}
        patches = merged(m, patches, own, g.merge_degrees, g.merge_distance, g.sweep_degrees, g.sweep_distance, g.sweep_share, p.quality, basis)
        patches = settled(m, saturated(m, patches, own, p, basis, p.saturation_rounds))
        out |= {m.fid[f]: (label, k) for k, (faces, _) in patches.items() for f in faces}
    return out


def relaxed(m, owned, distance, degrees, free_share, steal_factor):
    """``owned``: face to plane; turns one after the other."""
    pid = {f: owned.get(m.fid[f]) for f in range(len(m.fid))}
    ids = sorted({x for x in pid.values() if x is not None})
    base = {x: m.area[[f for f in pid if pid[f] == x]].sum() for x in ids}
    label = {x: m.label[next(f for f in pid if pid[f] == x)] for x in ids}
    for x in sorted(ids, key=lambda x: (-round(float(base[x]), 9), x)):
        own = [f for f in pid if pid[f] == x]
        if not own:
            continue
        p = m.points(own)
        n, d = huber_plane(p[np.lexsort(p.T[::-1])])
        beside = {g for f in own for g in m.near[f]} - set(own)
        cand = {f for f in beside if m.label[f] == label[x] and abs(m.normal[f] @ n) >= math.cos(math.radians(degrees)) and abs(m.middle[f] @ n + d) <= distance}
        free, seen = {f for f in cand if pid[f] is None}, set()
        for f in sorted(free):
            if f in seen:
                continue
            part, work = set(), [f]
            while work:
                u = work.pop()
                if u not in part:
                    part.add(u)
                    work += [g for g in m.near[u] if g in free]
            seen |= part
            if m.area[list(part)].sum() <= base[x] * free_share:
                for u in part:
                    pid[u] = x
        for other in sorted({pid[f] for f in cand if pid[f] is not None} - {x}):
            had = m.area[[f for f in pid if pid[f] == other]].sum()
            if label[other] == label[x] and had > 0 and base[x] >= steal_factor * had:
                for f in cand:
                    if pid[f] == other:
                        pid[f] = x
    return {m.fid[f]: x for f, x in pid.items() if x is not None}


def split(m, own, vertices, least, parts, mode):
    """{face: part} of one label by a queue of parts."""
    queue, done = [(1, list(own))], []
    while queue:
        number, cur = queue.pop(0)
        if len(done) + len(queue) + 1 >= parts:
            done += [(number, cur), *queue]
            break
        c = m.middle[cur]
        if len(cur) < 2 * least or len(np.unique(m.vertex[cur])) < vertices:
            done.append((number, cur))
            continue
        if mode == "pca":
            _, v = np.linalg.eigh(np.cov(c.T, bias=True))
            axis = v[:, -1] * np.sign(v[np.argmax(np.abs(v[:, -1])), -1])
        else:
            axis = np.eye(3)[np.argmax(c.var(axis=0))]
        at = c @ axis
        first = at <= np.median(at)
        a, b = [f for f, x in zip(cur, first, strict=True) if x], [f for f, x in zip(cur, first, strict=True) if not x]
        if not b:
            cur = sorted(cur, key=lambda f: m.fid[f])
            a, b = cur[: len(cur) // 2], cur[len(cur) // 2 :]
        if min(len(a), len(b)) < least:
            done.append((number, cur))
            continue
        queue += [(2 * number, a), (2 * number + 1, b)]
    return {m.fid[f]: number for number, cur in done for f in cur}
