"""JSON blocks within line-oriented text, in plain Python for the workers."""

from __future__ import annotations

import json


def _js_numbers(x):
    if isinstance(x, float) and x.is_integer():
        return int(x)
    if isinstance(x, dict):
        whole = sorted((k for k in x if k.isdigit() and str(int(k)) == k), key=int)
        return {k: _js_numbers(x[k]) for k in [*whole, *(k for k in x if k not in set(whole))]}
    return [_js_numbers(v) for v in x] if isinstance(x, list) else x


def minify_blocks(text: str) -> str:
    """JSON blocks that open with a bare bracket line become one line each; a
    block that does not close or parse stays, and its next line is tried."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        if lines[i].strip() in ("{", "["):
            depth = 0
            for j in range(i, len(lines)):
                depth += sum(c in "{[" for c in lines[j]) - sum(c in "}]" for c in lines[j])
                if depth == 0 and j > i:
                    break
            if depth == 0 and j > i:
                try:
                    out.append(json.dumps(_js_numbers(json.loads("\n".join(lines[i : j + 1]))), separators=(",", ":"), ensure_ascii=False))
                    i = j + 1
                    continue
                except ValueError:
                    pass
        out.append(lines[i])
        i += 1
    return "\n".join(out)
