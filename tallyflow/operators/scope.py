"""Sessions by the folders that they were recorded in. Folders are matched by equi-joins on a path's ancestors, so neither side is
looped over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.paths import ancestors, fold, folder_name


def sessions_for(sessions: DataFrame, requests: DataFrame, home: str) -> DataFrame:
    """(request, session_id): sessions recorded in a requested folder or in one above it.

    ``sessions``: (session_id, cwd), ``requests``: (request). A session of the home folder, of one above it or of the root matches its
    own folder only: else it would stand for every folder of the machine. Empty and null folders match nothing.
    """
    asked = requests.select("request", fold("request").alias("folder")).distinct().where("folder <> ''")
    asked = asked.select("request", "folder", F.explode(ancestors(F.col("folder"))).alias("at"))
    held = sessions.select("session_id", fold("cwd").alias("at")).where("at <> ''")
    high = F.array_contains(ancestors(fold("home")), F.col("at")) | (F.col("at") == "/")
    found = asked.join(held, "at").withColumn("home", F.lit(home))
    return found.where((F.col("at") == F.col("folder")) | ~high).select("request", "session_id")


def log_folders(requests: DataFrame) -> DataFrame:
    """(request, name): the names of the folders that can hold a requested folder's logs, its ancestors' included."""
    names = F.array_distinct(F.transform(ancestors(fold("request")), folder_name))
    return requests.select("request", F.explode(names).alias("name")).distinct()


def without_subtrees(files: DataFrame, roots: DataFrame, path: str = "file") -> DataFrame:
    """Rows of ``files`` whose path isn't one of ``roots`` (root) or below one."""
    above = files.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(ancestors(fold("_path"))).alias("_at"))
    gone = above.join(roots.select(fold("root").alias("_at")).distinct(), "_at", "left_semi").select("_path").distinct()
    return files.join(gone, files[path] == gone["_path"], "left_anti")
