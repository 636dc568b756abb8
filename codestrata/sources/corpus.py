"""Bodies of source code as tables: from a folder of files, or derived from the events table.

``files`` has path, language and content, one row per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language_of
from ..session import table

LINES_PER_FILE = 20

#: The derived corpus in SQL that Spark and other engines read alike; {s} is the string type. A line's
#: text follows from its event, a file holds the events of one run of LINES_PER_FILE ids.
FILE = f"CAST(floor(event_id / {LINES_PER_FILE}) AS BIGINT)"
LANGUAGE = "CASE CAST(f % 8 AS INT) WHEN 3 THEN 'javascript' WHEN 4 THEN 'python' WHEN 5 THEN 'java' WHEN 6 THEN 'go' WHEN 7 THEN 'ruby' ELSE 'php' END"
EXTENSION = "CASE CAST(f % 8 AS INT) WHEN 3 THEN '.js' WHEN 4 THEN '.py' WHEN 5 THEN '.java' WHEN 6 THEN '.go' WHEN 7 THEN '.rb' ELSE '.php' END"
FOLDER = "CASE CAST(f % 5 AS INT) WHEN 0 THEN 'src' WHEN 1 THEN 'app' WHEN 2 THEN 'vendor/lib' WHEN 3 THEN 'node_modules/x' ELSE 'tests' END"
PATH = f"'/corpus/' || {FOLDER} || '/f' || CAST(f AS {{s}}) || {EXTENSION}"
FUNCTION = f"CASE ({LANGUAGE}) WHEN 'php' THEN 'function fn' || {{e}} || '($a, $b) {{' WHEN 'javascript' THEN 'export async function fn' || {{e}} || '(a) {{' WHEN 'python' THEN 'def fn' || {{e}} || '(a):' WHEN 'java' THEN '  public int fn' || {{e}} || '(int a) {{' WHEN 'go' THEN 'func fn' || {{e}} || '(a int) {{' ELSE 'def fn' || {{e}} || '(' END"
CLASS = f"CASE ({LANGUAGE}) WHEN 'php' THEN 'class Kind' || {{e}} || ' extends Base' || {{m}} || ' implements Has, May {{' WHEN 'javascript' THEN 'class Kind' || {{e}} || ' extends Base' || {{m}} || ' {{' WHEN 'python' THEN 'class Kind' || {{e}} || '(Base' || {{m}} || '):' WHEN 'java' THEN 'public class Kind' || {{e}} || ' {{' ELSE '' END"
TARGET = "(f + user_id % 7 + 1)"
UP = "CASE CAST(f % 5 AS INT) WHEN 2 THEN '../../' WHEN 3 THEN '../../' ELSE '../' END"
INCLUDED = f"{UP} || {FOLDER.replace('f %', TARGET + ' %')} || '/f' || CAST({TARGET} AS {{s}}) || {EXTENSION.replace('f %', TARGET + ' %')}"
_E, _V, _W, _M = "CAST(event_id AS {s})", "CAST(user_id % 20 AS {s})", "CAST((user_id + 1) % 20 AS {s})", "CAST(user_id % 7 AS {s})"
TEMPLATES = [
    f"""'$q' || CAST(user_id AS {{s}}) || ' = "SELECT * FROM t WHERE id = " . $_GET["' || event_type || '"];'""",
    """'echo $_POST["' || event_type || '"]; echo $_GET["é' || event_type || '"];'""",
    """'include("../' || event_type || '/../x.php");'""",
    f"""'$password = "' || event_type || {_E} || 'padpad";'""",
    """'system("ls " . $_REQUEST["' || event_type || '"]);'""",
    """'// é ../' || event_type""",
    """'é mysqli_query("SEL" . "' || event_type || '" . $_GET["a"]);'""",
    """'db.query("x' || event_type || '" + a.$_POST["b"]);'""",
    """'el.innerHTML = "é' || event_type || '" + $_GET["c"];'""",
    """'document.write("' || event_type || '" + $_REQUEST["d"]);'""",
    """'fopen("' || event_type || '" . $_GET["p"]);'""",
    """'é os.system("ls" + request.' || event_type || ')'""",
    f"""'api_key = "' || event_type || CAST(1000000 + event_id AS {{s}}) || 'abcdefgh"; API-KEY = "0123456789abcdef"'""",
    """'private_key = "-----BEGIN ' || event_type || '"'""",
    FUNCTION.replace("{e}", _E),
    CLASS.replace("{e}", _E).replace("{m}", _M),
    f"""'$v' || {_V} || ' = $_GET["k"];'""",
    f"""'$v' || {_W} || ' = $v' || {_V} || ';'""",
    f"""'mysqli_query($c, $v' || {_V} || ');'""",
    f"""'$v' || {_V} || ' = htmlspecialchars($v' || {_V} || ');'""",
    f"""'md5($x); unserialize($v' || {_V} || ');'""",
    f"""CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'include' WHEN 1 THEN 'require_once' ELSE 'require' END || ' "' || {INCLUDED} || '";'""",
    f"""'use App' || chr(92) || 'Model' || {_M} || ' as Alias' || CAST(user_id % 5 AS {{s}}) || ';'""",
    f"""'echo $v' || {_V} || ';'""",
    """'if ($x > ' || CAST(user_id AS {s}) || ') {'""",
    """'for ($i = 0; $i < ' || CAST(user_id AS {s}) || '; $i++) {'""",
    "'return $x;'",
    "'switch ($x) {'",
    "'try {'",
    "'throw new Oops();'",
    f"""'  $secret_key = "abcdefghijkl' || {_E} || '" . $_COOKIE["s"];'""",
    f"""'fn' || CAST(event_id - 17 AS {{s}}) || '($a, "x" . $v' || {_V} || ');'""",
]
TEXT = f"CASE CAST(event_id % {len(TEMPLATES)} AS INT) " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TEMPLATES)) + " END"

#: The same corpus for the SQL twins: code_lines(path, language, f, line_no, text) and code_files.
SQL = f"""ev AS (SELECT *, {FILE} AS f FROM events),
code_lines AS (SELECT {PATH} AS path, {LANGUAGE} AS language, f, CAST(row_number() OVER (PARTITION BY f ORDER BY event_id) AS INT) AS line_no, {TEXT} AS text FROM ev),
code_files AS (SELECT path, language, f, string_agg(text, chr(10) ORDER BY line_no) AS content, list(text ORDER BY line_no) AS lines, max(line_no) AS n_lines FROM code_lines GROUP BY ALL)""".replace("{s}", "VARCHAR")


def events_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, language, content) derived from events. A file's lines come together by file number."""
    line = F.struct("event_id", F.expr(TEXT.replace("{s}", "STRING")).alias("text"))
    lines = table(spark, sf_dir, "events").withColumn("f", F.expr(FILE)).groupBy("f").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.select(F.expr(PATH.replace("{s}", "STRING")).alias("path"), F.expr(LANGUAGE).alias("language"), F.array_join(F.col("lines.text"), "\n").alias("content"))


def decoded(content: Column) -> Column:
    """Bytes as text. Of bytes that are not UTF-8 throughout, every one beyond ASCII becomes a question mark, so that offsets
    stay those of the bytes."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.decode(content, "ISO-8859-1"), "[^\\x00-\\x7F]", "?"))


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return read.option("pathGlobFilter", pattern).load(root)


def listed_path() -> Column:
    """A file's path, known from the listing: a filter on it decides which files are opened."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9+.-]+:(//[^/]*)?", "")


def folder_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, n_bytes, mtime of a folder's files, at any depth. No file is opened."""
    return _listed(spark, root, pattern).select(listed_path().alias("path"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("mtime"))


def folder_corpus(spark: SparkSession, root: str, pattern: str = "*", keep: Column | None = None) -> DataFrame:
    """files(path, language, content, n_bytes, sha256, mtime) of a folder, read recursively by Spark.

    ``keep`` is a condition on ``listed_path()``; Spark applies it to the listing, so other files are never opened. Files above the session's
    ``spark.sql.sources.binaryFile.maxLength`` are left out likewise, and those that cannot be read are passed over.
    """
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    read = _listed(spark, root, pattern).filter(F.col("_metadata.file_size") <= most)
    read = read if keep is None else read.filter(keep)
    return read.select(listed_path().alias("path"), "content", "length", "modificationTime").select(
        "path", language_of(F.col("path")).alias("language"), decoded(F.col("content")).alias("content"), F.col("length").alias("n_bytes"),
        F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"),
    )
