"""Plain versions of the operators for small inputs."""

import json
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    w = WORD.findall(ascii_lower(text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def near_duplicates(rows, threshold=75):
    """{doc_id: (shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        both = Counter(o for x in s for o in holders[x] if o < i)
        for o, k in both.items():
            if 100 * k >= threshold * (len(s) + len(sets[o]) - k):
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def base_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def overlaps(text, item, least=12, penalty=2):
    """Whether the best aligned stretch of any shift has ``least`` equal words."""
    a, b = plain_words(text), plain_words(item)
    for shift in range(-len(b) + 1, len(a)):
        run = best = 0
        equal = most = 0
        for i in range(max(0, shift), min(len(a), len(b) + shift)):
            hit = a[i] == b[i - shift]
            run, equal = run + (1 if hit else -penalty), equal + hit
            if run <= 0:
                run = equal = 0
            if run > best:
                best, most = run, equal
        if most >= least:
            return True
    return False


def fits(value, schema):
    """Whether ``value`` is of a schema (type, enum, properties, required, additionalProperties, items)."""
    kinds = {type(None): ["null"], bool: ["boolean"], str: ["string"], list: ["array"], dict: ["object"], int: ["integer", "number"]}
    kind = kinds.get(type(value)) or (["integer", "number"] if value == int(value) else ["number"])
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not set(types) & set(kind):
        return False
    if "enum" in schema and not any(type(x) is type(value) and x == value for x in schema["enum"]):
        return False
    if isinstance(value, dict):
        if set(schema.get("required", [])) - set(value):
            return False
        if "properties" in schema:
            known = schema["properties"]
            return all(fits(v, known[k]) if k in known else schema.get("additionalProperties", False) for k, v in value.items())
    return not (isinstance(value, list) and "items" in schema) or all(fits(v, schema["items"]) for v in value)


def _references(value, keys=False):
    if isinstance(value, str):
        return {value[1:]} if value.startswith("$") and len(value) > 1 else set()
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return set().union(*map(_references, inner))


def chat(rows, schemas):
    """{(conv_id, turn): (at_turn, at_call, message, n_calls, n_invalid, linked)} of rows with unique turns."""
    out, stacks, early = {}, defaultdict(list), defaultdict(list)
    for conv, turn, role, text in sorted(rows):
        out[conv, turn] = [turn, 0, {"content": text, "role": role}, 0, 0, None]
        try:
            said = json.loads(text) if role in ("assistant", "tool") and (text or "").startswith("{") else None
        except ValueError:
            said = None
        if role == "tool":
            out[conv, turn][5] = False
            if said and "tool_call_id" in said:
                own = out[conv, turn]
                own[2] = {**said, "content": said.get("content"), "role": "tool", "linked": False}
                key = conv, said["tool_call_id"]
                if stacks[key]:
                    own[0], own[1] = stacks[key].pop()
                    own[5] = own[2]["linked"] = True
                else:
                    early[key].append(own)
        elif role == "assistant" and said and said.get("tool_calls"):
            calls = []
            for c in said["tool_calls"]:
                c = {**c.get("function", {}), **c}
                given = c.get("arguments")
                try:
                    given = json.loads(given) if isinstance(given, str) else given
                except ValueError:
                    pass
                calls.append({"id": c.get("id"), "name": c.get("name"), "arguments": given, "valid": c.get("name") in schemas and fits(given, schemas[c["name"]])})
            after = {i: {j for j, d in enumerate(calls) if d["id"] in _references(c["arguments"])} for i, c in enumerate(calls)}
            order, left = [], set(after)
            while ready := sorted(i for i in left if not after[i] & left):
                order += ready
                left -= set(ready)
            for i in left:
                calls[i]["valid"] = False
            order += sorted(left)
            for place, i in enumerate(order, 1):
                if calls[i]["id"] is not None:
                    stacks[conv, calls[i]["id"]].append((turn, place))
            out[conv, turn] = [turn, 0, {**said, "content": said.get("content"), "role": "assistant", "tool_calls": [calls[i] for i in order]}, len(calls), sum(not c["valid"] for c in calls), None]
    for key, waiting in early.items():
        for own, (turn, place) in zip(waiting, stacks[key], strict=False):
            own[0], own[1], own[5] = turn, place, True
            own[2]["linked"] = True
    return {k: tuple(v) for k, v in out.items()}


def contexts(texts, order):
    """{context: {byte: count}} of all contexts of up to ``order`` bytes."""
    follow = defaultdict(Counter)
    for t in texts:
        for i, x in enumerate(t):
            for k in range(min(order, i) + 1):
                follow[t[i - k : i]][x] += 1
    return follow


def code_length(text, follow, order):
    """Bits of ``text`` by prediction by partial matching, method C with exclusion."""
    bits = 0.0
    for i, x in enumerate(text):
        out = set()
        for k in range(min(order, i), -1, -1):
            left = {y: c for y, c in follow.get(text[i - k : i], {}).items() if y not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if x in left:
                bits += math.log2(whole / left[x])
                break
            bits += math.log2(whole / len(left))
            out |= set(left)
        else:
            bits += math.log2(256 - len(out))
    return bits


def ftrl(rows, labels, features, p):
    """Weights and bias of FTRL-proximal over the rows in order; ``features`` gives a text's set of coordinates."""
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= p.l1 else -(z[k] - math.copysign(p.l1, z[k])) / ((p.beta + math.sqrt(n[k])) / p.alpha + p.l2)

    for _ in range(p.passes):
        for text, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in features(text)}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + bias)))) - y
            for k, own in w.items():
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / p.alpha * own
                n[k] += g * g
            bias_n += g * g
            bias -= p.alpha * g / (p.beta + math.sqrt(bias_n))
    return {k: weight(k) for k in z if weight(k)}, bias


def differencing(weights, shards):
    """Karmarkar-Karp by plain lists: sums of the shards, ascending."""
    parts = [[0] * (shards - 1) + [w] for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda x: x[-1] - x[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return parts[0]


def merkle(rows):
    """(doc_id, source, lang, n_chars, text) rows to sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    import hashlib
    import zlib

    def h(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def siblings(levels, at):
        out = []
        for nodes in levels[:-1]:
            out.append((at % 2, nodes[at ^ 1] if (at ^ 1) < len(nodes) else ""))
            at //= 2
        return out

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, k in enumerate(order):
        for i, (_, _, own, row) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            path = siblings(trees[j], i) + siblings(top, j)
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = leaf((*row[:3], row[3] + 1, row[4]))
            for right, other in path:
                node = h(other + node if right else node + other)
            out.append((row[0], own, trees[j][-1][0], top[-1][0], h("".join(x for _, x in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def simhash(text):
    """The fingerprint of a text, bit by bit."""
    import re

    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] or [" ".join(ws)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def simhash_groups(rows):
    """(doc_id, text) rows to sorted (doc_id, fingerprint, component_id), by all pairs."""
    prints = [simhash(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(distinct):
        for y in distinct[:k]:
            if (x ^ y).bit_count() <= 4:
                root[find(x)] = find(y)
    least = {}
    for (doc, _), x in zip(rows, prints, strict=True):
        if doc is not None:
            least[find(x)] = min(doc, least.get(find(x), doc))
    return sorted(((doc, f"{x:016x}", least.get(find(x))) for (doc, _), x in zip(rows, prints, strict=True)), key=str)


def vector_codes(rows, rounds=6, entries=16, parts=8):
    """(vec_id, embedding, label) rows to sorted (vec_id, code, error, label_error, codebooks_sha256), every distance taken."""
    import hashlib
    import math

    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    if not kept:
        return []
    w = len(whole[0]) // parts
    cut = [[v[j * w : (j + 1) * w] for j in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][j] for k in first] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min(range(len(books[j])), key=lambda e: (far(v[j], books[j][e]), e)) for j in range(parts)] for v in cut]

    for _ in range(rounds):
        codes = assigned()
        for j in range(parts):
            for e in range(len(books[j])):
                own = [v[j] for v, c in zip(cut, codes, strict=True) if c[j] == e]
                if own:
                    books[j][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assigned()
    errors = [sum(far(v[j], books[j][c[j]]) for j in range(parts)) for v, c in zip(cut, codes, strict=True)]
    totals = {}
    for r, error in zip(kept, errors, strict=True):
        totals[r[2]] = totals.get(r[2], 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), error, totals[r[2]], digest) for r, code, error in zip(kept, codes, errors, strict=True)), key=str)
