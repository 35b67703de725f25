"""Joining comments to threads, and files to repositories."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_comment(text: str, most: int = 8000) -> tuple[str, bool]:
    """The comment, cut at the last paragraph, sentence or word that ends before ``most`` characters; and whether it was cut."""
    if len(text) <= most:
        return text, False
    head = text[:most]
    for pattern in (r"\n", r"[.!?](?=\s)", r"\s"):
        if ends := [m.end() for m in re.finditer(pattern, head)]:
            return head[: ends[-1]].rstrip(), True
    return head, True


def usable_comments(comments: DataFrame, least_length: int = 20, least_score: int = 2, banned: Iterable[str] = ()) -> DataFrame:
    """Comments (body, author, score, subreddit) without those deleted, removed, short, low or of banned places."""
    gone = ["[deleted]", "[removed]"]
    rows = comments.where(~F.trim("body").isin(gone) & ~F.col("author").isin(gone) & (F.length("body") >= least_length) & (F.col("score") >= least_score))
    if names := sorted({b.lower() for b in banned}):
        bad = rows.sparkSession.createDataFrame([(b,) for b in names], "_bad string")
        rows = rows.join(F.broadcast(bad), F.lower("subreddit") == F.col("_bad"), "left_anti")  # a list given by hand
    return rows


def _paths(rows: pd.DataFrame, root: str) -> list[list[int]]:
    """Row numbers along each path from the root to a leaf; a comment of an unknown parent begins a path, cycles are cut."""
    at = {r: i for i, r in enumerate(rows["id"])}
    up = [at.get(p) if p != root else None for p in rows["parent_id"]]
    inner = {u for u in up if u is not None}
    out = []
    for i in range(len(rows)):
        if i in inner:
            continue
        path, seen, k = [], set(), i
        while k is not None and k not in seen:
            seen.add(k)
            path.append(k)
            k = up[k]
        out.append(path[::-1])
    return out


def linear_threads(comments: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(thread_id, path, text, n_comments) of every path of comments (thread_id, id, parent_id, body, score) from top to leaf.

    Paths are numbered by length, longest first, those that tie by their ids.  What an earlier path holds isn't repeated:
    a path that shares its beginning keeps only the comment before the new part.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        root = pdf["thread_id"].iloc[0]
        paths = sorted(_paths(pdf, root), key=lambda p: (-len(p), [pdf["id"][k] for k in p]))
        seen, out = set(), []
        for path in paths:
            new = next((i for i, k in enumerate(path) if k not in seen), len(path))
            path = path[max(0, new - 1) :]
            seen.update(path)
            out.append((root, len(out), separator.join(pdf["body"][k] for k in path), len(path)))
        return pd.DataFrame(out, columns=["thread_id", "path", "text", "n_comments"])

    return comments.select("thread_id", "id", "parent_id", "body", "score").groupBy("thread_id").applyInPandas(build, "thread_id string, path long, text string, n_comments long")


def longest_thread(comments: DataFrame) -> DataFrame:
    """Only the longest path of each thread."""
    return linear_threads(comments).where("path = 0").drop("path")


def rendered_threads(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """(thread_id, text) of every submission (thread_id, title, selftext) that has comments: its text and the comments as an indented tree,
    best score first, those that tie by id."""

    def build(key, posts: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if not len(posts) or not len(its):
            return pd.DataFrame({"thread_id": [], "text": []}).astype({"thread_id": str, "text": str})
        post = posts.sort_values("title").iloc[0]
        root, known = key[0], set(its["id"])
        below: dict = {}
        for r in its.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            below.setdefault(r.parent_id if r.parent_id in known else root, []).append(r)
        lines, stack, seen = [f"# {post['title']}", post["selftext"] or ""], [(r, 0) for r in reversed(below.get(root, []))], set()
        while stack:
            r, depth = stack.pop()
            if r.id in seen:
                continue
            seen.add(r.id)
            lines += [f"{'    ' * depth}{x}" for x in [f"{r.author}:", *r.body.split("\n")]]
            stack += [(c, depth + 1) for c in reversed(below.get(r.id, []))]
        return pd.DataFrame({"thread_id": [root], "text": ["\n".join(lines)]})

    return submissions.groupBy("thread_id").cogroup(comments.groupBy("thread_id")).applyInPandas(build, "thread_id string, text string")


def conversations(turns: DataFrame, separator: str = "\n") -> DataFrame:
    """(conv_id, text, n_turns) of conversations (conv_id, turn, role, text), turns in order as "role: text"."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    its = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(its, lambda t: t["line"]), separator).alias("text"), F.count("*").alias("n_turns"))


def concat_files(files: DataFrame, by: list[str], order_by: list[str], separator: str = "\n", text_col: str = "text") -> DataFrame:
    """(keys, text, files_concatenated): the files of each group, such as repository and language, joined in order."""
    its = F.sort_array(F.collect_list(F.struct(*order_by, F.col(text_col).alias("_t"))))
    return files.groupBy(*by).agg(F.array_join(F.transform(its, lambda t: t["_t"]), separator).alias("text"), F.count("*").alias("files_concatenated"))
