"""Version control diffs, old file versions and baselines as tables."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BASELINE, DIFFS

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def get_diff(repo: str, spec: str) -> str:
    return git(repo, "diff", "--unified=0", "--diff-filter=d", "--no-color", spec)


def old_ref(repo: str, spec: str) -> str:
    """The old side of a diff: the merge base of A...B, A of A..B, else the reference itself."""
    if "..." in spec:
        a, b = spec.split("...", 1)
        return git(repo, "merge-base", a or "HEAD", b or "HEAD").strip()
    return spec.split("..", 1)[0] or "HEAD"


def parse_diff(text: str) -> list[tuple]:
    """(file, kind, is_new, ranges, hunks) per file of a unified diff without context lines.

    Ranges are the new lines of hunks that add any; a file with deletions only has none.
    """
    out: list[dict] = []
    for line in text.splitlines():
        if line.startswith("diff --git "):
            out.append({"file": "", "kind": "Modified", "new": False, "ranges": [], "hunks": []})
        elif not out:
            continue
        elif line.startswith("new file mode"):
            out[-1].update(kind="Added", new=True)
        elif line.startswith("deleted file mode"):
            out[-1].update(kind="Deleted")
        elif line.startswith("+++ ") and not out[-1]["hunks"]:  # later ones are added lines
            path = line[4:].split("\t")[0].strip('"')
            if path != "/dev/null":
                out[-1]["file"] = path.removeprefix("b/")
        elif line.startswith("--- ") and not out[-1]["file"]:
            path = line[4:].split("\t")[0].strip('"')
            if path != "/dev/null":
                out[-1]["file"] = path.removeprefix("a/")
        elif m := HUNK.match(line):
            os, ol, ns, nl = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            out[-1]["hunks"].append((os, ol, ns, nl))
            if nl:
                out[-1]["ranges"].append((ns, ns + nl - 1))
    return [(d["file"], d["kind"], d["new"], d["ranges"], d["hunks"]) for d in out if d["file"]]


def rebase(path: str, git_root: str, scan_root: str) -> str | None:
    """A diff's path below the scan's root; None if it lies elsewhere."""
    full = f"{git_root.rstrip('/')}/{path}"
    root = scan_root.rstrip("/") + "/"
    return full.removeprefix(root) if full.startswith(root) else None


def diff_table(spark: SparkSession, text: str, git_root: str = "", scan_root: str = "") -> DataFrame:
    rows = parse_diff(text)
    if scan_root:
        rows = [(r, *rest) for f, *rest in rows if (r := rebase(f, git_root, scan_root)) is not None]
    return spark.createDataFrame(rows, DIFFS)


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, at, value): the lines of a diff's file, split over tasks; block and at give their order."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def numbered(lines: DataFrame, head: str) -> DataFrame:
    """`lines` (block, at, value) with segment: how many lines that begin with `head` stand up to here.

    A prefix scan in two passes: each block counts its heads, the few sums are added up along the
    blocks, and each block numbers its own lines from there. No block waits for another, and no
    line leaves its block.
    """
    is_head = F.startswith("value", F.lit(head))
    sums = lines.groupBy("block").agg(F.count_if(is_head).alias("heads"))
    before = F.sum("heads").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum(is_head.cast("int")).over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("inside", inside).join(sums, "block").withColumn("segment", F.col("before") + F.col("inside")).drop("inside", "before")


def diff_files(lines: DataFrame) -> DataFrame:
    """What `parse_diff` finds in the lines (block, at, value) of a unified diff without context, a row per
    file; a file's head may stand in another block than its hunks."""
    v = F.col("value")
    marks = ("diff --git ", "new file mode", "deleted file mode", "+++ ", "--- ", "@@ ")
    kept = numbered(lines.filter(v.rlike("^(" + "|".join(re.escape(m) for m in marks) + ")")), marks[0]).filter("segment > 0")
    named = F.btrim(F.substring_index(F.substring("value", 5, 2**31 - 1), "\t", 1), F.lit('"'))
    path = lambda mark, side: F.when(F.startswith("value", F.lit(mark)), F.struct(F.when(named != "/dev/null", F.regexp_replace(named, f"^{side}/", "")).alias("path")))
    number = lambda i, default: F.coalesce(F.nullif(F.regexp_extract("value", HUNK.pattern, i), F.lit("")).cast("int"), F.lit(default))
    hunk = F.struct("block", "at", number(1, 0).alias("os"), number(2, 1).alias("ol"), number(3, 0).alias("ns"), number(4, 1).alias("nl"))
    order = F.struct("block", "at")
    kind = F.when(F.startswith("value", F.lit(marks[1])), "Added").when(F.startswith("value", F.lit(marks[2])), "Deleted")
    plus, minus = path("+++ ", "b"), path("--- ", "a")
    # the first line of each kind is the file's head; later ones are added or removed lines
    files = kept.groupBy("segment").agg(
        F.min_by(plus, F.when(plus.isNotNull(), order)).alias("plus"),
        F.min_by(minus["path"], F.when(minus["path"].isNotNull(), order)).alias("minus"),
        F.coalesce(F.max_by(kind, F.when(kind.isNotNull(), order)), F.lit("Modified")).alias("kind"),
        F.coalesce(F.max(kind == "Added"), F.lit(False)).alias("is_new"),
        F.array_sort(F.collect_list(F.when(v.rlike(HUNK.pattern), hunk))).alias("found"),
    )
    hunks = F.transform("found", lambda h: F.struct(h["os"].alias("os"), h["ol"].alias("ol"), h["ns"].alias("ns"), h["nl"].alias("nl")))
    ranges = F.transform(F.filter("found", lambda h: h["nl"] > 0), lambda h: F.struct(h["ns"].alias("start"), (h["ns"] + h["nl"] - 1).alias("end")))
    return files.select(F.coalesce("plus.path", "minus").alias("file"), "kind", "is_new", ranges.alias("ranges"), hunks.alias("hunks")).filter("file <> ''")


def rebased(diff: DataFrame, folder: str) -> DataFrame:
    """The files of a diff below `folder`, named from there."""
    folder = folder.strip("/")
    if not folder:
        return diff
    return diff.filter(F.startswith("file", F.lit(folder + "/"))).withColumn("file", F.substring("file", len(folder) + 2, 2**31 - 1))


def old_sources(repo: str, ref: str, names: DataFrame) -> DataFrame:
    """(file, content) of an old version, for the files that `names` (file) lists; files that it did not have are absent.

    Paths count from `repo`, which may be a folder inside the repository and which tasks reach. Each
    task asks a `git` process of its own, one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        git_ = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                for name in batch.column("file").to_pylist():
                    if name is None or "\n" in name:
                        continue
                    git_.stdin.write(f"{ref}:./{name}\n".encode())
                    git_.stdin.flush()
                    head = git_.stdout.readline().rsplit(b" ", 2)
                    if not head[-1].strip().isdigit():  # missing, or no such reference
                        continue
                    content = git_.stdout.read(int(head[-1]) + 1)[:-1]
                    if head[-2] == b"blob":
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([content], pa.binary())], names=["file", "content"])
        finally:
            git_.stdin.close()
            git_.stdout.close()
            git_.wait()

    return names.select("file").mapInArrow(run, "file string, content binary")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline, a JSON array of entries; absent keys are "" and 0. `ord` numbers the entries as listed.

    A document whose lines are whole entries between two brackets, as `write_baseline` makes it, is read in parts by
    many tasks. Any other form, also one with a fault, is read whole by one task.
    """
    text = spark.read.text(path).select(F.btrim("value", F.lit(" \t\r\n")).alias("value"), F.monotonically_increasing_id().alias("at")).filter("value <> ''")
    bracket, open_ = F.col("value").isin("[", "]"), ~F.endswith("value", F.lit(","))
    # what stands on a line, without the comma that leads to the next one, as an array
    entries = F.from_json(F.concat(F.lit("["), F.regexp_replace("value", ",$", ""), F.lit("]")), f"array<struct<{BASELINE.replace(' ', ':').replace(',:', ',')}>>")
    body = lambda c: F.max(F.when(~bracket, c))
    seen = text.agg(
        F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"), F.count_if(bracket).alias("brackets"),
        F.count_if(~bracket & ~F.coalesce(F.startswith("value", F.lit("{")) & (F.size(entries) > 0), F.lit(False))).alias("odd"),
        F.count_if(~bracket & open_).alias("open"), body(F.col("at")).alias("end"), body(F.when(open_, F.col("at"))).alias("open_at"),
    ).first()
    in_lines = (seen["first"], seen["last"], seen["brackets"], seen["odd"]) == ("[", "]", 2, 0) and seen["open"] <= 1 and seen["open_at"] == seen["end"]
    raw = text.filter(~bracket).select(F.inline(entries)) if in_lines else spark.read.schema(BASELINE).option("multiLine", "true").json(path)
    return raw.select(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.monotonically_increasing_id().alias("ord"))
