"""An embedded database of any size that every executor can read: parts, each a Derby database in a file of the shared folder.

A database that is open for writing belongs to one JVM, and the writer over JDBC opens it in the driver's. So each part is loaded where its rows are: a task writes them as CSV,
Derby's own tool ``ij`` imports that, and the closed database is stored, uncompressed, in a jar. Databases in jars are read-only, and any number of JVMs read them.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import mounted, scratch

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
#: Rows of a part, about.
ROWS = 20_000


def _java() -> list[str]:
    """The command that runs Derby's tool, on the machine that it is called on."""
    from pyspark.find_spark_home import _find_spark_home

    home = os.environ.get("JAVA_HOME")
    jars = os.path.join(os.environ.get("SPARK_HOME") or _find_spark_home(), "jars", "*")
    return [os.path.join(home, "bin", "java") if home else "java", "-Xmx256m", "-Dderby.system.durability=test", "-cp", jars, "org.apache.derby.tools.ij"]


def _made(folder: str, table: str, columns: str, batches) -> str:
    """A part with the rows of batches; its URL."""
    from pyarrow import csv

    with tempfile.TemporaryDirectory() as own:
        own, writer = os.path.realpath(own), None
        for b in batches:
            if writer is None:
                writer = csv.CSVWriter(f"{own}/rows.csv", b.schema, write_options=csv.WriteOptions(include_header=False, quoting_style="all_valid"))
            writer.write_batch(b)
        lines = [f"connect 'jdbc:derby:{own}/db;create=true'", "call SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.storage.pageSize', '4096')", f"create table {table} ({columns})"]
        if writer:
            writer.close()
            lines.append(f"""call SYSCS_UTIL.SYSCS_IMPORT_DATA(null, '{table.upper()}', null, null, '{own}/rows.csv', ',', '"', 'UTF-8', 1)""")
        with open(f"{own}/load.sql", "w") as f:
            f.write(";\n".join([*lines, "disconnect", "connect 'jdbc:derby:;shutdown=true'", "exit", ""]))
        said = subprocess.run([*_java(), f"{own}/load.sql"], cwd=own, capture_output=True, text=True)
        # the answer to a shutdown is an error, too
        if said.returncode or [e for e in said.stdout.split("\n") if e.removeprefix("ij> ").startswith("ERROR ") and "XJ015" not in e]:
            raise RuntimeError(f"a part was not loaded: {said.stdout[-2000:]}{said.stderr[-2000:]}")
        name = f"{folder}/{uuid.uuid4().hex}.jar"
        os.makedirs(folder, exist_ok=True)
        with zipfile.ZipFile(f"{name}.tmp", "w", zipfile.ZIP_STORED) as z:
            for at, _, files in os.walk(f"{own}/db"):
                for f in files:
                    z.write(f"{at}/{f}", os.path.relpath(f"{at}/{f}", own))
        shutil.move(f"{name}.tmp", name)
    return f"jdbc:derby:jar:({name})db"


def load(rows: DataFrame, table: str, columns: str, size: int = ROWS) -> list[str]:
    """Write rows as a table of a database in parts of about size rows; their URLs. columns: as in CREATE TABLE, in the order of the rows'.

    The database needs files: a shared folder that isn't mounted raises."""
    folder = mounted(rows.sparkSession, scratch(rows.sparkSession, "database"))
    if folder is None:
        raise ValueError("an embedded database needs files: set spark.checkpoint.dir to a mounted folder")

    def part(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"url": [_made(folder, table, columns, batches)]})

    parts = max(1, -(-rows.count() // size))
    made = rows.repartition(parts, F.monotonically_increasing_id()).mapInArrow(part, "url string").collect()
    # a plan that is known to be empty has no tasks
    return sorted(r["url"] for r in made) or [_made(folder, table, columns, [])]
