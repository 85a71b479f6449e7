"""Relevance of files for a task, and keyword questions to the knowledge base."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tessella.symbols.store import KnowledgeBase

#: Words that say nothing about a task or question, by use.
_COMMON_WORDS = frozenset(
    """a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should
    may might must shall can need this that these those i you we they it""".split()
)
TASK_WORDS = _COMMON_WORDS | frozenset("implement add create make build fix update".split())
QUESTION_WORDS = _COMMON_WORDS | frozenset("where what how why when which who find show get list tell me about".split())
#: Parts of paths that hold other people's code.
VENDOR_PATHS = ("SDK", "Packages/", "ThirdParty/", "Plugins/", "External/", "Vendor/", "Dependencies/", "node_modules/")
#: Points for a task.
VENDOR, IN_PATH, NAME_IS, NAME_HAS, IN_NAMESPACE, MEMBER_IS, MEMBER_HAS = -10, 3, 10, 5, 2, 5, 3
#: Points for a question: name, part of a name and member, and what they come in.
ASK_SYMBOL, ASK_MEMBER, ASK_NAMESPACE, ASK_SIGNATURE = (20, 10, 8), (15, 7, 5), 3, 4
DEPENDENTS_WARNED = 5


def words_of(text: str, ignored: frozenset[str], shortest: int) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9\s]", " ", text.lower()).split() if len(w) >= shortest and w not in ignored]


def _points(text: Column, token: str, exact: int, part: int, piece: int = 0) -> Column:
    """Points of one token for a name: equal, contained, or equal to a part between capitals."""
    low = F.coalesce(F.lower(text), F.lit(""))
    out = F.when(low == token, exact).when(F.contains(low, F.lit(token)), part)
    if piece:
        out = out.when(F.exists(F.split(F.coalesce(text, F.lit("")), "(?=[A-Z])"), lambda p: F.lower(p) == token), piece)
    return out.otherwise(0)


def _in(text: Column, token: str, points: int) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(token)), points).otherwise(0)


def _excluded(path: Column, patterns: list[str] | None) -> Column:
    out = F.lit(False)
    for p in patterns or []:
        p = p.rstrip("*")
        out = out | path.startswith(p) | F.contains(path, F.lit("/" + p))
    return out


def _member_points(token: str):
    return lambda m: _points(m["name"], token, MEMBER_IS, MEMBER_HAS)


def score_symbols(symbols: DataFrame, tokens: list[str]) -> DataFrame:
    """(relativePath, at, name, score) of symbols with points for a task."""
    total = F.lit(0)
    for t in tokens:
        total = total + _points(F.col("name"), t, NAME_IS, NAME_HAS) + _in(F.col("namespace"), t, IN_NAMESPACE)
        inner = F.transform(F.col("members"), _member_points(t))
        total = total + F.coalesce(F.aggregate(inner, F.lit(0), lambda a, x: a + x), F.lit(0))
    return symbols.select("relativePath", "at", "name", total.alias("score")).filter("score > 0")


def relevant_files(kb: KnowledgeBase, task: str, max_files: int = 10, exclude: list[str] | None = None) -> DataFrame:
    """(file, score, matchedSymbols) of the files that a task is likely about, best first."""
    tokens = words_of(task, TASK_WORDS, 3)
    path = F.col("relativePath")
    own = F.when(path.rlike("(?i)" + "|".join(re.escape(v) for v in VENDOR_PATHS)), VENDOR).otherwise(0)
    for t in tokens:
        own = own + _in(path, t, IN_PATH)
    files = kb.file_symbols.select("relativePath", own.alias("own"))
    matched = score_symbols(kb.symbols, tokens).groupBy("relativePath").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("at", "name"))).alias("hits"))
    rows = files.join(matched, "relativePath", "left").withColumn("score", F.col("own") + F.coalesce("score", F.lit(0))).filter("score > 0").filter(~_excluded(path, exclude))
    names = F.transform(F.coalesce("hits", F.array().cast("array<struct<at:int,name:string>>")), lambda h: h["name"])
    return rows.select(path.alias("file"), "score", names.alias("matchedSymbols")).orderBy(F.desc("score"), "file").limit(max_files)


def context(kb: KnowledgeBase, task: str, max_files: int = 10, exclude: list[str] | None = None) -> dict:
    """Files for a task, with who implements their interfaces, what many files depend on, and where to begin."""
    files = relevant_files(kb, task, max_files, exclude).collect()  # max_files rows
    top = kb.symbols.filter(F.col("relativePath").isin([f["file"] for f in files]))
    faces = top.filter("kind = 'interface'").select(F.col("name").alias("interface")).distinct()
    uses = kb.symbols.select("relativePath", "at", F.col("name").alias("user"), F.explode("bases").alias("interface"))
    mapped = uses.join(faces, "interface").groupBy("interface").agg(F.sort_array(F.collect_list(F.struct("relativePath", "at", "user"))).alias("users"))
    mapped = mapped.select("interface", F.transform("users", lambda u: u["user"]).alias("implementations")).orderBy("interface")
    named = top.select(F.col("name").alias("type")).distinct()
    counts = kb.edges.join(named, "type").groupBy("type").agg(F.count("*").alias("n")).filter(F.col("n") >= DEPENDENTS_WARNED).orderBy(F.desc("n"), "type")
    return {
        "task": task,
        "files": [r.asDict() for r in files],
        "interfaceMap": [r.asDict() for r in mapped.collect()],
        "warnings": [{"symbol": r["type"], "dependentCount": r["n"], "message": f"{r['type']} is used by {r['n']} files; changes reach all of them"} for r in counts.collect()],
        "startingPoints": [f"{', '.join(r['matchedSymbols'][:2]) or r['file']} in {r['file']}" for r in files[:3]],
    }


def score_question(kb: KnowledgeBase, question: str) -> DataFrame:
    """(file, symbol, member, kind, line, namespace, bases, snippet, score) of all symbols and members with points, best first."""
    tokens = words_of(question, QUESTION_WORDS, 2)
    own, inner = F.lit(0), F.lit(0)
    for t in tokens:
        own = own + _points(F.col("name"), t, *ASK_SYMBOL) + _in(F.col("namespace"), t, ASK_NAMESPACE)
        inner = inner + _points(F.col("name"), t, *ASK_MEMBER) + _in(F.col("signature"), t, ASK_SIGNATURE)
    bases = F.when(F.size("bases") > 0, F.concat(F.lit(" : "), F.array_join("bases", ", "))).otherwise("")
    symbols = kb.symbols.select("relativePath", "at", F.lit(-1).alias("member_at"), F.col("name").alias("symbol"), F.lit(None).cast("string").alias("member"), "kind", "line", "namespace", "bases", F.concat("kind", F.lit(" "), "name", bases).alias("snippet"), own.alias("score"))
    facts = kb.symbols.select("relativePath", "at", "bases")
    members = kb.members.select("relativePath", "at", "member_at", "symbol", F.col("name").alias("member"), "kind", "line", "namespace", F.coalesce("signature", F.concat("kind", F.lit(": "), "name")).alias("snippet"), inner.alias("score"))
    members = members.filter("score > 0").join(facts, ["relativePath", "at"])
    rows = symbols.filter("score > 0").unionByName(members)
    return rows.orderBy(F.desc("score"), "relativePath", "at", "member_at").withColumnRenamed("relativePath", "file").drop("at", "member_at")


def ask(kb: KnowledgeBase, question: str) -> dict:
    """A worded answer with the ten best places, related symbols and further questions."""
    rows = score_question(kb, question)
    top, n = rows.limit(10).collect(), rows.count()
    if not n:
        return {"answer": "Nothing in the knowledge base matches this question. Try other words, or index the project first.", "files": [], "relatedSymbols": [], "suggestedQuestions": []}
    tokens = words_of(question, QUESTION_WORDS, 2)
    name = lambda r: f"{r['symbol']}.{r['member']}" if r["member"] else r["symbol"]
    files = {r["file"] for r in top}
    answer = f"{n} matches for \"{', '.join(tokens[:3])}\". The best is **{name(top[0])}** in `{top[0]['file']}`."
    if len(files) > 1:
        answer += f" The first ten are in {len(files)} files."
    more: list[str] = []
    for r in top[:5]:
        more += [f"What classes inherit from {b}?" for b in r["bases"] or []]
        if r["namespace"] and len(set(more)) < 3:
            more.append(f"What other classes are in the {'.'.join(r['namespace'].split('.')[:2])} namespace?")
    related = list({(r["symbol"], r["file"]): {"name": r["symbol"], "file": r["file"]} for r in top[:5]}.values())
    root = (kb.meta.get("rootPath") or "").rstrip("/")
    places = [{"path": f"{root}/{r['file']}" if root else r["file"], "relativePath": r["file"], "symbol": name(r), "line": r["line"], "snippet": r["snippet"], "score": r["score"]} for r in top]
    return {"answer": answer, "files": places, "relatedSymbols": related, "suggestedQuestions": list(dict.fromkeys(more))[:3]}
