"""Minimum spans of mentions and NP-only pruning on a bracketed parse column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phrase tags that may head a minimum span, and tags of words that may not be in one.
NOUN, VERB = ("NP", "NM", "QP", "NX"), ("VP",)
CLOSED = ("CC", "DT", "IN")
_PIECE = re.compile(r"\(([A-Za-z]*)[^()*]*|(\*)|(\))")


@dataclass
class Node:
    tag: str
    children: list = field(default_factory=list)
    words: list | None = None  # (index, word, pos) of a leaf

    @property
    def kind(self) -> str:
        return self.tag[:2]


def read_tree(words: list[str], pos: list[str], parse: list[str]) -> Node | None:
    """Tree of a mention's slice of the parse column; brackets may be unbalanced.  Several roots get an NP above them.

    Neighbouring words that no bracket parts are one leaf.
    """
    roots: list[Node] = []
    stack: list[Node] = []
    leaf: list[tuple] = []

    def flush() -> None:
        if leaf:
            node = Node("", words=leaf.copy())
            stack[-1].children.append(node) if stack else roots.append(node)
            leaf.clear()

    for i, cell in enumerate(parse):
        for m in _PIECE.finditer(cell):
            if m[2]:
                leaf.append((i, words[i], pos[i]))
                continue
            flush()
            if m[3]:
                if stack and not (done := stack.pop(), stack)[1]:
                    roots.append(done)
            else:
                node = Node(m[1])
                if stack:
                    stack[-1].children.append(node)
                stack.append(node)
    flush()
    if stack:
        roots.append(stack[0])
    return None if not roots else roots[0] if len(roots) == 1 else Node("NP", roots)


def counts(leaf: Node) -> bool:
    """A leaf that may be in a minimum span: some word has a letter or digit or is %, is no bracket and of no closed class."""
    return any((any(c.isalnum() for c in w) or w == "%") and w not in ("-LRB-", "-RRB-") and p not in CLOSED for _, w, p in leaf.words)


def shallowest(root: Node, tags: tuple[str, ...] | None) -> list[Node]:
    """Counting leaves nearest to the root below phrases of the tags; without tags, the first noun or verb phrase sets them."""
    level, top = [root], True
    while level:
        if hit := [n for n in level if n.words is not None and counts(n)]:
            return hit
        below = []
        for n in (n for n in level if n.words is None):
            if tags is None:
                tags = NOUN if n.kind in ("NP", "NM") else VERB if n.kind == "VP" else None
            own = tags is not None and n.kind in tags
            if top or own or tags is None:
                below += [c for c in n.children if c.words is None or own]
        level, top = below, False
    return []


def min_span(words: list[str], pos: list[str], parse: list[str]) -> tuple[str | None, list[str]]:
    """(root tag, sorted index:word items): the words by which a mention is known."""
    root = read_tree(words, pos, parse)
    leaves: list[Node] = []
    if root is not None and root.words is not None:
        leaves = [root] if counts(root) else []
    elif root is not None:
        kinds = [c.kind for c in root.children]
        tags = VERB if root.kind == "VP" or root.kind not in ("NP", "NM") and "VP" in kinds and not {"NP", "NM"} & set(kinds) else NOUN
        leaves = [c for c in root.children if c.words is not None and counts(c)]
        if not leaves:
            phrases = [c for c in root.children if c.words is None and c.children and c.kind in tags]
            leaves = [x for p in phrases for x in shallowest(p, tags)] if phrases else shallowest(root, None)
    items = [(i, w) for n in leaves for i, w, _ in n.words] or list(enumerate(words))
    return root.tag if root else None, [f"{i}:{w}" for i, w in sorted(items)]


def _frame(words: pd.Series, pos: pd.Series, parse: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([min_span(list(a), list(b), list(c)) for a, b, c in zip(words, pos, parse, strict=True)], columns=["tag", "span"])


def span_of(words: Column, pos: Column, parse: Column) -> Column:
    """struct<tag, span> of the arrays of a mention's words, tags and parse cells; the span array is its identity."""
    return F.pandas_udf(_frame, "tag string, span array<string>")(words, pos, parse)


def noun_phrases_only(mentions: DataFrame, partial: bool = True) -> DataFrame:
    """Mentions doc, cluster, tag without verb phrases; a cluster that lost one goes if at most one is left, or always without partial."""
    verb = F.coalesce(F.col("tag") == "VP", F.lit(False))
    part = W.partitionBy("doc", "cluster")
    both = mentions.withColumns({"_verb": verb, "_lost": F.count_if(verb).over(part), "_left": F.count_if(~verb).over(part)})
    keep = ~F.col("_verb") & ((F.col("_lost") == 0) | ((F.col("_left") > 1) & F.lit(partial)))
    return both.where(keep).drop("_verb", "_lost", "_left")
