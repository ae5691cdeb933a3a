"""What screening means for one proposal, stated with sets and tables in plain Python, for comparison."""

import unicodedata

import regex

from titlesieve.functions import wording as w
from titlesieve.functions.phonetic import word_key


def normal(title):
    plain = unicodedata.normalize("NFKC", title).casefold()
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split())


def domain_of(d):
    return "-".join("-".join(part.split()) for part in d.strip().lower().split("-")) if d else "unknown"


def latin(t):
    letters = regex.findall(r"\p{L}", t)
    return t != "" and len(regex.findall(r"\p{Latin}", "".join(letters))) >= 0.8 * len(letters)


def code(t):
    keys = [word_key(x) for x in normal(t).split()] if latin(t) else []
    return " ".join(filter(None, keys)) or None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def token_set(a, b):
    sa, sb = set(a.split()), set(b.split())
    if not sa or not sb:
        return 0.0
    both = " ".join(sorted(sa & sb))
    x, y = " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    if both and not (x and y):
        return 100.0
    gap = 1 if both else 0
    la, lb = len(both) + gap + len(x), len(both) + gap + len(y)
    best = 100.0 - 100.0 * (len(x) + len(y) - 2 * lcs(x, y)) / (la + lb)
    if both:
        best = max(best, 100.0 - 100.0 * (gap + len(x)) / (len(both) + la),
                   100.0 - 100.0 * (gap + len(y)) / (len(both) + lb))
    return best


def token_sort(a, b):
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(x) + len(y)
    return 100.0 if not total else (1.0 - (total - 2.0 * lcs(x, y)) / total) * 100.0


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def signals(asked, held, similarity, cfg):
    """(final, semantic, lexical, phonetic, exact) of a pair of titles."""
    a, b, ka, kb = normal(asked), normal(held), code(asked), code(held)
    if a and a == b:
        return 1.0, 1.0, 1.0, (1.0 if ka and kb else None), True
    lexical = max(token_set(a, b), token_sort(a, b)) / 100 if a and b else 0.0
    phonetic = (1.0 if ka == kb else token_set(ka, kb) / 100) if ka and kb else None
    values = [min(max(similarity, 0.0), 1.0), lexical] + ([] if phonetic is None else [phonetic])
    weights = cfg.pair_weights if phonetic is None else (cfg.semantic_weight, cfg.lexical_weight, cfg.phonetic_weight)
    return min(sum(x * y for x, y in zip(values, weights)), 1.0), values[0], lexical, phonetic, False


def candidates(p, corpus, vectors, centroids, cfg):
    """Records in the order of their discovery with their similarity, and the probed clusters. The passes as
    sets: equal normal forms; admitted neighbours; best titles of the scope."""
    usable = {r["id"]: r for r in corpus if r["record_status"] in ("active", "approved")}
    equal = {i for i, r in usable.items() if normal(r["title"]) == normal(p["title"])}

    def closeness(c):
        return -dot(p["embedding"], c["centroid"]) / (dot(c["centroid"], c["centroid"]) ** 0.5 + 1e-9), c["cluster_id"]

    probed = [c["cluster_id"] for c in sorted(centroids, key=closeness)][: cfg.cluster_top_n]
    near = {i: dot(p["embedding"], v) for i, v in vectors.items()}
    fetched = [i for i in sorted(near, key=lambda i: (-near[i], i))[: cfg.vector_fetch] if i in usable]
    others = [i for i in fetched if i not in equal]
    admitted = [i for place, i in enumerate(others) if place < cfg.top_k or not probed or usable[i]["cluster_id"] in probed]
    in_order = sorted(usable)
    scope = [i for i in in_order if usable[i]["cluster_id"] in probed] if probed else in_order[: cfg.fallback_rows]
    first, last = {}, {}
    for i in scope:
        first.setdefault(usable[i]["title"], i)
        last[usable[i]["title"]] = i
    alike = {t: token_set(p["title"], t) for t in first}
    titles = [t for t in sorted(first, key=lambda t: (-alike[t], first[t]))[: cfg.top_k] if alike[t] >= cfg.fuzzy_floor]
    order = dict.fromkeys([*sorted(equal), *admitted, *(last[t] for t in titles)])
    seen = {*admitted, *(i for i in fetched if i in equal)}
    return [(usable[i], near[i] if i in seen else 0.0) for i in order], probed


def screen_one(p, corpus, vectors, centroids, cfg):
    """``p`` and ``corpus`` rows are dicts, ``vectors`` maps id to a unit vector."""
    found, probed = candidates(p, corpus, vectors, centroids, cfg)
    if not found:
        return {"decision": w.CLEAR, "risk": w.LOW, "final_score": 0.0, "reasons": [w.REASON_NO_CANDIDATES],
                "explanation": w.SENTENCE_NO_CANDIDATES, "matches": [], "candidate_count": 0}
    told = [(signals(p["title"], r["title"], similarity, cfg), r) for r, similarity in found]
    shown = [(tuple(None if x is None else round(x, 4) for x in s[:4]), s[4], r) for s, r in told]
    shown.sort(key=lambda x: -x[0][0])
    (final, semantic, lexical, phonetic), _, best = shown[0]
    exact = any(e for _, e, _ in shown)
    final = 1.0 if exact else final
    outcomes = ((cfg.conflict_threshold, w.CONFLICT, w.HIGH, w.SENTENCE_CONFLICT), (cfg.review_threshold, w.REVIEW, w.MEDIUM, w.SENTENCE_REVIEW),
                (float("-inf"), w.CLEAR, w.LOW, w.SENTENCE_CLEAR))
    decision, risk, sentence = next(o[1:] for o in outcomes if final >= o[0])
    asked, domains = domain_of(p["domain"]), {domain_of(r["domain"]) for _, _, r in shown[: cfg.domain_lookback]}
    table = (
        (exact, w.REASON_EXACT),
        (not exact and lexical >= cfg.lexical_reason_min, w.REASON_LEXICAL),
        (not exact and semantic >= cfg.semantic_reason_min, w.REASON_SEMANTIC),
        (not exact and (phonetic or 0.0) >= cfg.phonetic_reason_min, w.REASON_PHONETIC),
        (asked in domains - {"", "unknown"}, w.REASON_DOMAIN),
        (best["cluster_id"] in probed, w.REASON_CLUSTER),
    )
    reasons = [text for holds, text in table if holds] or [w.REASON_NOTHING if decision == w.CLEAR else w.REASON_MIXED]
    for slot, value in (("%1$s", p["title"]), ("%2$s", best["title"]), ("%3$s", f"{final:.2f}")):
        sentence = sentence.replace(slot, value)
    return {"decision": decision, "risk": risk, "final_score": round(final, 4), "reasons": reasons, "explanation": sentence,
            "candidate_count": len(shown),
            "matches": [(r["id"], s[1], s[2], s[3], s[0]) for s, _, r in shown[: cfg.top_matches]]}


STATUS_OF = {w.CONFLICT: w.STATUS_REJECTED, w.REVIEW: w.STATUS_PENDING, w.CLEAR: w.STATUS_APPROVED}


def submit_one_by_one(batch, corpus, vectors, centroids, cfg):
    """Sequential intake: each proposal is screened, stored and visible to the next."""
    held, out = list(corpus), []
    for number, p in enumerate(sorted(batch, key=lambda r: r["seq"]), start=max(r["id"] for r in corpus) + 1):
        verdict = screen_one(p, held, vectors, centroids, cfg)
        stored = {"id": number, "record_status": STATUS_OF[verdict["decision"]]}
        held.append(stored | {"title": p["title"], "domain": domain_of(p["domain"]), "cluster_id": None})
        out.append(verdict | {"submission_id": number, "record_status": stored["record_status"], "proposal_id": p["proposal_id"]})
    return out
