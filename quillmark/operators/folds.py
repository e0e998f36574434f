"""Rules whose steps depend on what came before, one group at a time in Arrow batches.

Groups are a page's blocks or a document's claims.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# Bounds and share of the height within which blocks stand on one line, and the gap that asks for a space.
LOWEST, HIGHEST, SHARE, GAP = 0.006, 0.018, 0.65, 0.006


def visual_lines(blocks: DataFrame) -> DataFrame:
    """(doc, page, line, text, x, y, width, height, n) of (doc, page, ord, x, y, width, height, text) blocks.

    Blocks are taken by y, x and order; each joins the first line whose running mean
    y is near enough, by the taller of the two heights.
    """
    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[dict] = []
        for b in pdf.sort_values(["y", "x", "ord"], kind="stable").itertuples():
            for line in lines:
                if abs(line["y"] - b.y) <= max(LOWEST, min(HIGHEST, SHARE * max(b.height, line["blocks"][0].height))):
                    n = len(line["blocks"])
                    line["y"] = (line["y"] * n + b.y) / (n + 1)
                    line["blocks"].append(b)
                    break
            else:
                lines.append({"y": b.y, "blocks": [b]})
        out = []
        for i, line in enumerate(lines):
            own = sorted(line["blocks"], key=lambda b: (b.x, b.ord))
            text = own[0].text
            for a, b in zip(own, own[1:], strict=False):
                tight = b.x - (a.x + a.width) <= GAP and not (a.text[-1:].isascii() and (a.text[-1:].isalnum() or a.text[-1:] == ")") and b.text[:1].isascii() and (b.text[:1].isalnum() or b.text[:1] == "("))
                text += ("" if tight else " ") + b.text
            left, right = min(b.x for b in own), max(b.x + b.width for b in own)
            out.append((own[0].doc, own[0].page, i, " ".join(text.split()), left, min(b.y for b in own), right - left, max(b.height for b in own), len(own)))
        return pd.DataFrame(out, columns=["doc", "page", "line", "text", "x", "y", "width", "height", "n"])

    return blocks.groupBy("doc", "page").applyInPandas(cluster, "doc long, page int, line int, text string, x double, y double, width double, height double, n int")


def reused_ids(claims: DataFrame, previous: DataFrame) -> DataFrame:
    """(doc, pos, previous_id): which earlier claim each new claim continues, each at most once.

    Both hold (doc, pos, id, text, sources array<long>). For each new claim in
    order, an unused earlier claim with the same text and, by preference, the same
    sources, some common source, or no sources on both sides, is taken.
    """
    def match(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        left, out = list(old.sort_values("pos").itertuples()), []
        for c in new.sort_values("pos").itertuples():
            mine = set(c.sources)
            tiers = [lambda p, m=mine: m and set(p.sources) == m, lambda p, m=mine: bool(m & set(p.sources)), lambda p, m=mine: not m and not len(p.sources)]
            found = next((p for tier in tiers for p in left if p.text == c.text and tier(p)), None)
            if found is not None:
                left.remove(found)
            out.append((c.doc, c.pos, None if found is None else found.id))
        return pd.DataFrame(out, columns=["doc", "pos", "previous_id"])

    return claims.groupBy("doc").cogroup(previous.groupBy("doc")).applyInPandas(match, "doc long, pos long, previous_id string")
