"""References against definitions: anti-joins, resolution, shadowing.

``keys`` names the columns that tell projects apart (``("project_id",)``): every join, window and total is then within a
project, so that a name of one never resolves a name of another. Without keys all rows are one project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.pairs import tiled_join

Keys = tuple[str, ...]

# Suffixes and index files that a relative import may stand for, in the order in which they are tried.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py")
INDEX_FILES = ("/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py")
# The same for the target of a path alias, files of a dotted Python module, and folders in which it may lie.
ALIAS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
DOTTED_SUFFIXES = (".py", "/__init__.py")
SOURCE_ROOTS = ("", "backend/", "src/")
# Folders that an alias may stand for where a project configures none, in the order in which they are tried.
COMMON_ALIASES = {"@/": ("src", "app", "lib", ""), "~/": ("src", "app", "lib", ""), "@": ("src", "app", "lib")}
# Objects that a class provides, and globals whose members are asked about even behind a cast.
OWN_OBJECTS = ("this", "self", "cls")
GLOBALS = "window navigator document location history localStorage sessionStorage console process global globalThis Intl".split()


def unresolved_references(usages: DataFrame, catalog: DataFrame, imports: DataFrame | None = None, locals_: DataFrame | None = None, builtins: DataFrame | None = None, key: str = "symbol_id", kinds: tuple[str, ...] = ("call", "instantiation", "reference"), strict: bool = False, keys: Keys = ()) -> DataFrame:
    """Usages that name nothing. Built-ins are the same for all projects.

    Loose: any definition, import, local or built-in of the name resolves it. Strict: only definitions and imports of
    the usage's own file do, and ``exists_in_project`` tells a name that is defined elsewhere but not imported.
    """
    open_ = usages.where(F.col("usage_type").isin(*kinds))
    names = lambda df, *more: df.select(*keys, key, *more).distinct()
    own = [*keys, *(["file"] if strict else []), key]
    sources = [catalog, *(x for x in (imports, locals_) if x is not None)]
    for source in sources:
        open_ = open_.join(names(source, *(["file"] if strict else [])), own, "left_anti")
    if builtins is not None:
        open_ = open_.join(builtins.select(key).distinct(), key, "left_anti")
    if not strict:
        return open_
    return open_.join(names(catalog).withColumn("__defined", F.lit(True)), [*keys, key], "left").withColumn("exists_in_project", F.col("__defined").isNotNull()).drop("__defined")


def unresolved_methods(
    usages: DataFrame, catalog: DataFrame, trusted: list[str], known_roots: DataFrame, members: DataFrame | None = None, classes: DataFrame | None = None, internal: DataFrame | None = None, keys: Keys = ()
) -> DataFrame:
    """Method calls ``(file, object, member)`` with ``finding``: the object's root is unknown (undefinedVariable, critical), else no definition has the name without a scope or in the object's scope (nonExistentMethod, medium).

    Nothing is asked about objects of the class itself, trusted roots, objects without a root name (literals,
    expressions) and built-in ``members(member)``. An object may be an instance of a class of ``classes(name)`` with its
    name in PascalCase; that class is then a scope too. With ``internal(file, name)``, the imports whose module is a file
    of the project, a method is only asked about on roots imported so, as others belong to packages. The condition on the
    scope is equi anti-joins rather than one with an OR.
    """
    root = F.regexp_extract("object", r"^\s*([^\s?.\[(+\-*/%|&<>=!~^`'\"]+)\s*(?:[?.\[(].*)?$", 1)
    calls = usages.withColumn("__root", root).where(F.col("__root") != "").where(~F.col("__root").isin(*OWN_OBJECTS, *trusted))
    if members is not None:
        calls = calls.join(members.select("member").distinct(), "member", "left_anti")
    roots = known_roots.select(*keys, F.col("root").alias("__root")).distinct()
    unknown = calls.join(roots, [*keys, "__root"], "left_anti").select(*usages.columns, F.lit("undefinedVariable").alias("finding"), F.lit("critical").alias("severity"))
    rest = calls.join(roots, [*keys, "__root"], "left_semi")
    if internal is not None:
        rest = rest.join(internal.select(*keys, "file", F.col("name").alias("__root")).distinct(), [*keys, "file", "__root"], "left_semi")
    free = catalog.where("scope is null").select(*keys, F.col("name").alias("member")).distinct()
    scoped = catalog.where("scope is not null").select(*keys, F.col("name").alias("member"), F.col("scope").alias("object")).distinct()
    missing = rest.join(free, [*keys, "member"], "left_anti").join(scoped, [*keys, "member", "object"], "left_anti")
    missing = missing.join(scoped.withColumnRenamed("object", "__root"), [*keys, "member", "__root"], "left_anti")
    if classes is not None:
        of_class = scoped.join(classes.select(*keys, F.col("name").alias("object")).distinct(), [*keys, "object"], "left_semi").withColumnRenamed("object", "__class")
        pascal = F.concat(F.upper(F.substring("__root", 1, 1)), F.expr("substring(__root, 2)"))
        missing = missing.withColumn("__class", F.when(F.lower(F.substring("__root", 1, 1)) == F.substring("__root", 1, 1), pascal)).join(of_class, [*keys, "member", "__class"], "left_anti")
    return unknown.unionByName(missing.select(*usages.columns, F.lit("nonExistentMethod").alias("finding"), F.lit("medium").alias("severity")))


def validate_dependencies(imports: DataFrame, manifest: DataFrame, registry: DataFrame, aliases: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """External ``package`` imports that the project's manifest lacks: in the registry missingDependency/low/100, else dependencyHallucination/critical/99. Registry and aliases are the same for all projects."""
    named = imports
    if aliases is not None:
        named = imports.join(aliases.select("package", "provides"), "package", "left").withColumn("package", F.coalesce("provides", "package")).drop("provides")
    missing = named.join(manifest.select(*keys, "package").distinct(), [*keys, "package"], "left_anti")
    known = missing.join(registry.select("package").distinct().withColumn("__known", F.lit(True)), "package", "left")
    there = F.col("__known").isNotNull()
    return known.select(*imports.columns, F.when(there, "missingDependency").otherwise("dependencyHallucination").alias("finding"), F.when(there, "low").otherwise("critical").alias("severity"), F.when(there, 100).otherwise(99).alias("confidence"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, dotted: bool = False, keys: Keys = ()) -> DataFrame:
    """``imports`` with ``target``: the first existing file among the candidates of ``module``; null if none exists.

    ``module`` is the path that the import names, from the project's root (relative ones are resolved before). With
    ``aliases(prefix, target)`` a module that names no file itself is tried behind the longest alias it begins with, then
    the next shorter one; so each module is exploded into its beginnings, which meet the aliases on equality. With ``dotted`` a module like ``a.b.c`` is tried as a Python module below the source roots.
    Candidates are exploded with their place and joined on equality, so that no import is compared with every file.
    """
    js = F.regexp_replace("module", r"\.js$", "")
    jsx = F.regexp_replace("module", r"\.jsx$", "")
    names = [F.col("module")]
    names += [F.when(F.col("module").endswith(".js"), F.concat(js, F.lit(s))) for s in (".ts", ".tsx")]
    names += [F.when(F.col("module").endswith(".jsx"), F.concat(jsx, F.lit(s))) for s in (".tsx", ".ts")]
    names += [F.concat("module", F.lit(s)) for s in (*SUFFIXES[1:], *INDEX_FILES)]
    modules = imports.select(*keys, "module").where("module is not null").distinct()
    exploded = lambda df, way, candidates: df.select(*keys, "module", F.lit(way).alias("way"), F.posexplode(candidates).alias("place", "target")).where("target is not null")
    each = exploded(modules, 0, F.array(*names)).withColumn("short", F.lit(0))
    if aliases is not None:
        known = aliases.select(*keys, "prefix", F.col("target").alias("base")).where("prefix <> '' and base is not null").groupBy(*keys, "prefix").agg(F.min("base").alias("base"))
        # A module meets the aliases by each of its beginnings that is no longer than the longest alias.
        longest = known.agg(F.max(F.char_length("prefix")).alias("n")).first()["n"] or 0
        upto = F.least(F.char_length("module"), F.lit(longest))
        near = modules.where(upto > 0).select(*keys, "module", F.explode(F.sequence(F.lit(1), upto)).alias("n"))
        near = near.withColumn("prefix", F.expr("substring(module, 1, n)")).join(known, [*keys, "prefix"])
        path = F.regexp_replace(F.regexp_replace(F.concat_ws("/", "base", F.expr("substring(module, n + 1)")), "/+", "/"), "^/", "")
        behind = near.select(*keys, "module", "n", F.regexp_replace(path, "/$", "").alias("path"))
        tried = behind.select(*keys, "module", F.lit(1).alias("way"), F.posexplode(F.array(*(F.concat("path", F.lit(s)) for s in ALIAS_SUFFIXES))).alias("place", "target"), (-F.col("n")).alias("short"))
        each = each.unionByName(tried)
    if dotted:
        path = F.translate("module", ".", "/")
        tried = exploded(modules.where(F.col("module").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$")), 2, F.array(*(F.concat(F.lit(r), path, F.lit(s)) for r in SOURCE_ROOTS for s in DOTTED_SUFFIXES)))
        each = each.unionByName(tried.withColumn("short", F.lit(0)))
    there = files.select(*keys, F.col("file").alias("target")).distinct()
    found = each.join(there, [*keys, "target"]).groupBy(*keys, "module").agg(F.min_by("target", F.struct("way", "short", "place")).alias("target"))
    return imports.join(found, [*keys, "module"], "left").select(*imports.columns, "target")


def common_aliases(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(prefix, target)``: what the usual aliases stand for in a project without a configuration: the first of their folders that has files."""
    top = F.when(F.col("file").contains("/"), F.substring_index("file", "/", 1))
    own = files.select(*keys, top.alias("dir")).where("dir is not null").distinct()
    own = own.unionByName(files.select(*keys).distinct().withColumn("dir", F.lit(""))) if keys else own.unionByName(files.limit(1).select(F.lit("").alias("dir")))
    options = F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(d).alias("dir"), F.lit(i).alias("place")) for p, dirs in COMMON_ALIASES.items() for i, d in enumerate(dirs)))
    met = own.select(*keys, "dir", F.explode(F.filter(options, lambda o: o["dir"] == F.col("dir"))).alias("o"))
    return met.groupBy(*keys, F.col("o.prefix").alias("prefix")).agg(F.min_by("dir", "o.place").alias("target"))


def unresolved_imports(resolved: DataFrame, exports: DataFrame, keys: Keys = ()) -> DataFrame:
    """Imports ``(file, module, name, target)`` whose module has no file (missingModule, 99) or whose file doesn't export the name (missingExport, 93); ``*`` and ``default`` always resolve."""
    gone = resolved.where("target is null").withColumns({"finding": F.lit("missingModule"), "confidence": F.lit(99)})
    there = exports.select(*keys, F.col("file").alias("target"), "name").distinct()
    unnamed = resolved.where("target is not null and name not in ('*', 'default')").join(there, [*keys, "target", "name"], "left_anti")
    return gone.unionByName(unnamed.withColumns({"finding": F.lit("missingExport"), "confidence": F.lit(93)}))


def arity_check(usages: DataFrame, catalog: DataFrame, key: str = "symbol_id", keys: Keys = ()) -> DataFrame:
    """Calls whose number of arguments lies outside the definition's range."""
    ranges = catalog.select(*keys, key, "param_min", "param_max")
    return usages.join(ranges, [*keys, key]).where("arg_count < param_min or arg_count > param_max")


def unused_imports(imports: DataFrame, used: list[DataFrame], skip: Column | None = None, keys: Keys = ()) -> DataFrame:
    """Imports ``(file, name)`` whose name no table of ``used`` (names, call objects, types) has in the same file."""
    names = used[0].select(*keys, "file", "name")
    for more in used[1:]:
        names = names.unionByName(more.select(*keys, "file", "name"))
    rest = imports if skip is None else imports.where(~skip)
    return rest.join(names.distinct(), [*keys, "file", "name"], "left_anti")


def type_only_misuse(imports: DataFrame, usages: DataFrame, kinds: tuple[str, ...] = ("call", "instantiation", "methodCall"), keys: Keys = ()) -> DataFrame:
    """Type-only imports used as values, with the first such line."""
    typed = imports.where("is_type_only").select(*keys, "file", "name").distinct()
    return usages.where(F.col("usage_type").isin(*kinds)).join(typed, [*keys, "file", "name"]).groupBy(*keys, "file", "name").agg(F.min("line").alias("line"))


def unused_exports(catalog: DataFrame, imported: DataFrame, other_uses: list[DataFrame], key: str = "symbol_id", keys: Keys = ()) -> DataFrame:
    """Exported definitions that nothing imports or uses; the smaller tables come first."""
    open_ = catalog.where("exported")
    for uses in (imported, *other_uses):
        open_ = open_.join(uses.select(*keys, key).distinct(), [*keys, key], "left_anti")
    return open_


def orphan_files(files: DataFrame, edges: DataFrame, exports: DataFrame, imported_names: DataFrame, skip: Column | None = None, keys: Keys = ()) -> DataFrame:
    """Files with exports, without importer, none of whose exported names is imported anywhere."""
    some = files if skip is None else files.where(~skip)
    own = [*keys, "file"]
    some = some.join(exports.select(*own).distinct(), own, "left_semi").join(edges.select(*keys, F.col("dst").alias("file")).distinct(), own, "left_anti")
    taken = exports.join(imported_names.select(*keys, "name").distinct(), [*keys, "name"], "left_semi").select(*own).distinct()
    return some.join(taken, own, "left_anti")


def unused_definitions(symbols: DataFrame, tokens: DataFrame, keys: Keys = ()) -> DataFrame:
    """Definitions ``(file, name)`` whose name occurs at most once as a token of its file; exported, ``_x`` and hook names aside."""
    own = [*keys, "file", "name"]
    counts = tokens.groupBy(*own).agg(F.count("*").alias("__n"))
    open_ = symbols.where("not exported").where(~F.col("name").rlike("^_|^use[A-Z]"))
    return open_.join(counts.where("__n > 1"), own, "left_anti")


def unused_members(members: DataFrame, instances: DataFrame, accesses: DataFrame, keys: Keys = ()) -> DataFrame:
    """Members ``(class, member)`` of classes that have exported instances, none of which is accessed by the member anywhere.

    ``instances(class, instance)``; ``accesses(instance, member)``.
    """
    held = members.join(instances.select(*keys, "class").distinct(), [*keys, "class"], "left_semi")
    used = instances.join(accesses.select(*keys, "instance", "member").distinct(), [*keys, "instance"]).select(*keys, "class", "member").distinct()
    return held.join(used, [*keys, "class", "member"], "left_anti")


def scope_resolve(refs: DataFrame, closure: DataFrame, scope_symbols: DataFrame, imports: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """``refs(scope, name)`` with ``defined_in`` and ``how``: the nearest enclosing scope with the name, else an import, else global."""
    near = refs.join(closure.select(*keys, F.col("node").alias("scope"), "ancestor", "distance"), [*keys, "scope"])
    near = near.join(scope_symbols.select(*keys, F.col("scope").alias("ancestor"), "name").distinct(), [*keys, "ancestor", "name"])
    best = near.groupBy(*keys, "scope", "name").agg(F.min_by("ancestor", "distance").alias("defined_in"))
    out = refs.join(best, [*keys, "scope", "name"], "left")
    if imports is None:
        return out.withColumn("how", F.when(F.col("defined_in").isNotNull(), "scope").otherwise("global"))
    out = out.join(imports.select(*keys, "name").distinct().withColumn("__imported", F.lit(True)), [*keys, "name"], "left")
    return out.withColumn("how", F.when(F.col("defined_in").isNotNull(), "scope").when(F.col("__imported"), "import").otherwise("global")).drop("__imported")


def shadowed_symbols(closure: DataFrame, scope_symbols: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(scope, name, shadows)``: names that an enclosing scope has too, with the nearest such scope."""
    own = scope_symbols.select(*keys, "scope", "name").distinct()
    outer = closure.where("distance > 0").select(*keys, F.col("node").alias("scope"), "ancestor", "distance")
    met = own.join(outer, [*keys, "scope"]).join(own.select(*keys, F.col("scope").alias("ancestor"), "name"), [*keys, "ancestor", "name"])
    return met.groupBy(*keys, "scope", "name").agg(F.min_by("ancestor", "distance").alias("shadows"))


def bridge_edges(symbols: DataFrame, strings: DataFrame, keys: Keys = ()) -> DataFrame:
    """Routes (names that begin with a slash) to other files that hold the same string: ``(src, dst, name, confidence)``. A frequent path is joined in tiles."""
    routes = symbols.where(F.col("name").startswith("/")).select(*keys, "name", F.col("file").alias("dst")).distinct()
    uses = strings.select(*keys, "name", F.col("file").alias("src")).distinct()
    met = tiled_join(uses, routes, [*keys, "name"], "src", "dst")
    return met.where("src <> dst").select(*keys, "src", "dst", "name", F.lit(0.9).alias("confidence"))


def relations_of(symbols: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Each symbol with the sorted lists of its callers and callees; ``edges(src, dst)``. For symbols with very many of them see ``usage.postings``."""
    callers = edges.groupBy(*keys, F.col("dst").alias("symbol")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    callees = edges.groupBy(*keys, F.col("src").alias("symbol")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))
    none = lambda c: F.coalesce(c, F.array().cast("array<bigint>"))
    own = [*keys, "symbol"]
    return symbols.join(callers, own, "left").join(callees, own, "left").withColumns({"callers": none("callers"), "callees": none("callees")})


def unknown_types(type_refs: DataFrame, types: DataFrame, builtins: list[str], accesses: DataFrame | None = None, typed: DataFrame | None = None, properties: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """Type references to nothing in ``types(name)``. With ``accesses`` a table of findings of both kinds instead.

    ``accesses(id, object, property)`` are held against the properties of the object's type: ``typed(object, type)``,
    ``properties(type, property)``. Objects of unknown type and types without a list of properties say nothing. The
    findings ``(id, finding, name, severity, confidence)`` are nonExistentType/high/85 and nonExistentProperty/high/70.
    """
    unknown = type_refs.where(~F.col("name").isin(*builtins)).join(types.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")
    if accesses is None:
        return unknown
    lists = properties.select(*keys, "type", "property").distinct()
    known = typed.select(*keys, "object", "type").distinct().join(lists.select(*keys, "type").distinct(), [*keys, "type"], "left_semi")
    asked = accesses.select(*keys, "id", "object", "property").distinct().join(known, [*keys, "object"])
    # An object that may have one of several types has the properties of all.
    held = asked.join(lists, [*keys, "type", "property"], "left_semi").select(*keys, "id", "object", "property").distinct()
    missing = asked.join(held, [*keys, "id", "object", "property"], "left_anti").select(*keys, "id", F.lit("nonExistentProperty").alias("finding"), F.concat_ws(".", "object", "property").alias("name"), F.lit("high").alias("severity"), F.lit(70).alias("confidence")).distinct()
    return unknown.select(*keys, "id", F.lit("nonExistentType").alias("finding"), "name", F.lit("high").alias("severity"), F.lit(85).alias("confidence")).unionByName(missing)


def find_symbol(requests: DataFrame, symbols: DataFrame, keys: Keys = ()) -> DataFrame:
    """For each request ``(id, name, file, scope)`` the best definition ``symbol``: same file and scope, same file, same scope, else the first by file and symbol.

    Each of the four is one join with the first definition of its key, so that a frequent name costs a request no more
    than a rare one. Requests whose name nobody defines give no row; a null scope is a scope of its own.
    """
    scoped = lambda df: df.withColumn("scope", F.coalesce(F.concat(F.lit("="), F.col("scope").cast("string")), F.lit("-")))
    out, found = scoped(requests).select(*keys, "id", "name", "file", "scope"), scoped(symbols)
    ways = (["name", "file", "scope"], ["name", "file"], ["name", "scope"], ["name"])
    for i, way in enumerate(ways):
        own = [*keys, *way]
        out = out.join(found.groupBy(*own).agg(F.min(F.struct("file", "symbol")).alias(f"__{i}")), own, "left")
    # A request that is there more than once keeps its best way.
    best = F.coalesce(*(F.when(F.col(f"__{i}").isNotNull(), F.struct(F.lit(i).alias("way"), F.col(f"__{i}.file").alias("f"), F.col(f"__{i}.symbol").alias("symbol"))) for i in range(len(ways))))
    return out.withColumn("best", best).where("best is not null").groupBy(*keys, "id").agg(F.min("best").alias("best")).select(*keys, "id", "best.symbol")


def closed_namespaces(usages: DataFrame, members: DataFrame, keys: Keys = (), lines: bool = False) -> DataFrame:
    """Usages of roots with a closed list ``members(root, member)`` whose member isn't listed; the lists are the same for all projects.

    With ``lines`` usages also have ``code``, their line, and ``before``, the line above, and findings get ``severity`` and
    ``confidence``: a global behind a cast to any or unknown is critical/96, a root other than a global is high/85 where a
    comment suppresses the type check on the line or above it, all others are medium/86.
    """
    found = usages.join(members.select("root").distinct(), "root", "left_semi").join(members.select("root", "member").distinct(), ["root", "member"], "left_anti")
    if not lines:
        return found
    code, above = (F.coalesce(c, F.lit("")) for c in ("code", "before"))
    cast = F.col("root").cast("string").isin(*GLOBALS) & code.rlike(r"as (any|unknown)")
    silenced = ~F.col("root").cast("string").isin(*GLOBALS) & (code.rlike("@ts-(ignore|expect-error)") | above.rlike("@ts-(ignore|expect-error)"))
    pick = lambda a, b, c: F.when(cast, a).when(silenced, b).otherwise(c)
    return found.withColumns({"severity": pick("critical", "high", "medium"), "confidence": pick(96, 85, 86)})


# Severity and confidence of findings in handlers.
HANDLER_FINDINGS = {"noResponse": ("high", 75), "unknownModel": ("high", 85), "unknownProperty": ("high", 80), "unusedLocal": ("medium", 78)}


def broken_handlers(handlers: DataFrame, facts: DataFrame, models: DataFrame, fields: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """``(handler, finding, name)`` from facts ``(handler, fact, name)``: no response and no next; a query on a model that doesn't exist; a local that is assigned and never read.

    With ``fields(model, field)`` facts of the kind access name ``model.field``: one that a model with known fields lacks is
    an unknownProperty; and every finding gets its ``severity`` and ``confidence``.
    """
    own = [*keys, "handler"]
    answers = facts.where("fact in ('respond', 'next')").select(*own).distinct()
    silent = handlers.select(*own).distinct().join(answers, own, "left_anti").select(*own, F.lit("noResponse").alias("finding"), F.lit(None).cast("string").alias("name"))
    queried = facts.where("fact = 'query'").select(*own, "name").distinct().join(models.select(*keys, "name").distinct(), [*keys, "name"], "left_anti").select(*own, F.lit("unknownModel").alias("finding"), "name")
    unread = facts.where("fact = 'assign'").select(*own, "name").distinct().join(facts.where("fact = 'read'").select(*own, "name").distinct(), [*own, "name"], "left_anti").select(*own, F.lit("unusedLocal").alias("finding"), "name")
    out = silent.unionByName(queried).unionByName(unread)
    if fields is None:
        return out
    listed = fields.select(*keys, "model", "field").distinct()
    accessed = facts.where("fact = 'access'").select(*own, "name", F.substring_index("name", ".", 1).alias("model"), F.expr("substring(name, length(substring_index(name, '.', 1)) + 2)").alias("field")).distinct()
    lost = accessed.join(listed.select(*keys, "model").distinct(), [*keys, "model"], "left_semi").join(listed, [*keys, "model", "field"], "left_anti")
    out = out.unionByName(lost.select(*own, F.lit("unknownProperty").alias("finding"), "name"))
    value = lambda i: F.create_map(*(F.lit(x) for k, v in HANDLER_FINDINGS.items() for x in (k, v[i])))[F.col("finding")]
    return out.withColumns({"severity": value(0), "confidence": value(1)})


def latest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__r = 1").drop("__r")
