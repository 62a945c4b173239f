"""Plain versions that several tests share."""

import re


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def near_duplicate_groups(texts):
    """A group number per text: 5-word Jaccard similarity of 0.8 or more, and what it reaches."""
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or a and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(text, items):
    ws = " ".join(["", *words(text), ""])
    for item in items:
        iw = words(item)
        n = min(10, len(iw))
        if n and any(" ".join(["", *iw[s:s + n], ""]) in ws for s in range(len(iw) - n + 1)):
            return True
    return False


def redacted(text):
    """The strong kinds only: the table has no weak parts."""
    if text is None:
        return None
    spans = [m.span() for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
             if len(m[1]) >= 6]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [m.span() for m in re.finditer(r"[0-9a-f]{24,}", text)]
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:]
