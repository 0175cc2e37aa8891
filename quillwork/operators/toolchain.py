"""Checks that call a compiler. Off unless asked for: the code is untrusted.

Nothing is run but the compiler itself, in a folder of its own, with limits on memory, time and
file size. A language without its tool on the executor gives false and says so.
"""

from __future__ import annotations

import ast
import re
import resource
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillwork.operators.code_checks import VERSIONS

SECONDS = 10
#: Lines of a compiler's output that are messages.
MESSAGE = re.compile(r"^(?:\S+:\d+|(?:[\w+.-]+: )?(?:fatal |internal compiler )?(?:error|warning))(?:[:\[ ]|$)", re.I)
MEGABYTES = 2048
#: Language to file name and command; the command is called in the file's folder.
COMMANDS = {
    "java": ("Test.java", ["javac", "-proc:none", "-d", ".", "Test.java"]),
    "c": ("main.c", ["gcc", "-fsyntax-only", "main.c"]),
    "cpp": ("main.cpp", ["g++", "-fsyntax-only", "main.cpp"]),
    "c++": ("main.cpp", ["g++", "-fsyntax-only", "main.cpp"]),
    "javascript": ("main.js", ["node", "--check", "main.js"]),
    "typescript": ("main.ts", ["tsc", "--noEmit", "main.ts"]),
    "rust": ("main.rs", ["rustc", "--crate-type", "lib", "--emit", "metadata", "main.rs"]),
    "go": ("main.go", ["gofmt", "-e", "main.go"]),
    "kotlin": ("main.kt", ["kotlinc", "main.kt", "-d", "out.jar"]),
    "haskell": ("Main.hs", ["ghc", "-fno-code", "Main.hs"]),
    "lua": ("main.lua", ["luac", "-p", "main.lua"]),
    "coffeescript": ("main.coffee", ["coffee", "-c", "main.coffee"]),
    "c#": ("main.cs", ["csc", "-nologo", "-target:library", "main.cs"]),
}


def _limits() -> None:
    size = MEGABYTES << 20
    resource.setrlimit(resource.RLIMIT_CPU, (SECONDS, SECONDS))
    resource.setrlimit(resource.RLIMIT_FSIZE, (100 << 20, 100 << 20))
    resource.setrlimit(resource.RLIMIT_DATA, (size, size))


def _python(code: str, version: str | None) -> tuple[bool, str | None]:
    minor = int(version.split(".")[1]) if version and version.count(".") else None
    try:
        ast.parse(code, feature_version=minor and (3, minor))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return False, str(error)
    return True, None


def compiles(code: str | None, language: str | None, version: str | None = None) -> tuple[bool, str | None]:
    language = (language or "").strip().lower()
    if version and language in VERSIONS and version not in VERSIONS[language]:
        return False, f"{version} isn't among the known versions of {language}"
    if language == "python":
        return _python(code or "", version)
    if language not in COMMANDS:
        return False, f"no compiler is known for {language or 'no language'}"
    name, command = COMMANDS[language]
    if version and language == "java":
        command = [command[0], "--release", version.removeprefix("jdk"), *command[1:]]
    elif version and language == "rust":
        command = [command[0], f"+{version}", *command[1:]]
    if not shutil.which(command[0]):
        return False, f"{command[0]} isn't installed"
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, name).write_text(code or "", encoding="utf-8", errors="replace")
        try:
            done = subprocess.run(command, cwd=folder, capture_output=True, encoding="utf-8", errors="replace", timeout=SECONDS, preexec_fn=_limits, start_new_session=True)
        except subprocess.TimeoutExpired:
            return False, f"stopped after {SECONDS} s"
        except (OSError, subprocess.SubprocessError) as error:
            return False, f"{command[0]} can't be run: {error}"
    reason = _diagnostics(done.stderr) or _diagnostics(done.stdout) or None
    return done.returncode == 0, reason if done.returncode == 0 else reason or _ended(done.returncode)


def _ended(status: int) -> str:
    return f"exit status {status}" if status > 0 else f"ended by signal {-status}"


def _diagnostics(output: str) -> str:
    """The compiler's messages without the lines of source that it quotes, which may be of other files."""
    return "\n".join(line for line in output.splitlines() if MESSAGE.search(line))[:2000]


def check_compilation(df: DataFrame, code: str = "generated_code", language: str = "language", version: str | None = None, allow: bool = False) -> DataFrame:
    """df with is_matched and error_message by the compiler of each row's language.

    allow: has to be true, so that nobody hands untrusted code to compilers unawares. version: a
    column with the language version asked for.
    """
    if not allow:
        raise PermissionError("compilers see untrusted code only with allow=True")
    schema = T.StructType([*df.schema.fields, T.StructField("is_matched", T.BooleanType()), T.StructField("error_message", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            versions = batch[version] if version else [None] * len(batch)
            done = [compiles(c, n, v) for c, n, v in zip(batch[code], batch[language], versions)]
            yield batch.assign(is_matched=[ok for ok, _ in done], error_message=[why for _, why in done])

    return df.mapInPandas(run, schema)
