"""Operators as callables with a contract: kinds of parameters, effects, result envelopes, self-checks, staged runs, files.

The operators themselves are in `recipes`; here they are described, checked, called, staged and written down.
"""

from __future__ import annotations

import importlib
import inspect
import json
import pkgutil
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.plans import recipes

KINDS = ("text", "number", "flag", "list", "mapping", "reference")
#: transform makes tables that stay in the state; query makes a result of its own.
EFFECTS = ("transform", "query")
#: Parameters whose values name columns or tables of the state.
_REFERENCES = ("_key", "groupby", "keys", "gene_list", "s_genes", "g2m_genes")


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    default: Any
    required: bool


@dataclass
class Result:
    """What a call gave: status completed or failed, the tables it made, what changed in the state, a log, an error."""

    status: str
    frames: dict[str, DataFrame] = field(default_factory=dict)
    changed: dict[str, str] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)
    error: str | None = None


def params_of(op: recipes.Operator) -> list[Param]:
    def kind(name: str, default: Any) -> str:
        if name.endswith(_REFERENCES):
            return "reference"
        if isinstance(default, bool):
            return "flag"
        if isinstance(default, (int, float)):
            return "number"
        if isinstance(default, (list, tuple)) or name in ("edges", "radii", "interior_labels"):
            return "list"
        if isinstance(default, dict) or name == "intercepts":
            return "mapping"
        return "number" if name in ("bandwidth",) else "text"

    return [Param(n, kind(n, d), None if d is recipes.REQUIRED else d, d is recipes.REQUIRED) for n, d in op.params.items()]


def typed(op: recipes.Operator, given: dict[str, Any]) -> dict[str, Any]:
    """The bound parameters, each of its kind; texts of numbers and flags become those, anything else is an error. Null, blank
    texts and empty lists are unset; 0 and false are values."""
    given = {k: v for k, v in given.items() if v is not None and v != "" and v != [] and v != {}}
    out = op.bind(given)
    for p in params_of(op):
        v = out[p.name]
        if p.name not in given:
            continue
        if p.kind == "number" and isinstance(v, str):
            try:
                out[p.name] = int(v) if v.lstrip("-").isdigit() else float(v)
            except ValueError:
                raise ValueError(f"{op.key}: {p.name} is a number, not {v!r}") from None
        elif p.kind == "flag" and isinstance(v, str):
            if v.lower() not in ("true", "false"):
                raise ValueError(f"{op.key}: {p.name} is true or false, not {v!r}")
            out[p.name] = v.lower() == "true"
        elif p.kind == "list" and not isinstance(v, (list, tuple)) or p.kind == "mapping" and not isinstance(v, dict):
            raise ValueError(f"{op.key}: {p.name} is a {p.kind}, not {v!r}")
    return out


def effect_of(op: recipes.Operator) -> str:
    return "transform" if set(op.makes) & {n for o in recipes.OPERATORS.values() for n in o.needs} else "query"


def missing_references(op: recipes.Operator, given: dict[str, Any], state: recipes.State) -> list[str]:
    """Columns that reference parameters name and the tables an operator needs do not have; gene lists are checked by name or
    number among the genes there are."""
    columns = {c for n in (*op.needs, "obs", "points") if n in state for c in state[n].columns}
    out = []
    for p in params_of(op):
        v = given.get(p.name)
        if p.kind != "reference" or not v:
            continue
        if p.name.endswith(("_list", "_genes")):
            have = {r["var"] for r in state["counts"].where(F.col("var").isin(list(v))).select("var").distinct().collect()}  # those asked for
            out += [str(g) for g in v if g not in have]
        else:
            out += [c for c in ([v] if isinstance(v, str) else v) if c not in columns]
    return out


def call(key: str, state: recipes.State, given: dict[str, Any] | None = None) -> Result:
    """Run one operator; errors become a failed result, the state stays as it was."""
    started = time.monotonic()
    try:
        if key not in recipes.OPERATORS:
            raise ValueError(f"no operator {key!r}")
        op = recipes.OPERATORS[key]
        params = typed(op, given or {})
        if missing := [n for n in op.needs if n not in state]:
            raise ValueError(f"{key} needs {', '.join(missing)}")
        if absent := missing_references(op, params, state):
            raise ValueError(f"{key}: there is no {', '.join(absent)}")
        made = op.run(state, **params)
    except Exception as e:  # noqa: BLE001 - whatever an operator raises is its result
        return Result("failed", log=[f"{key} failed after {time.monotonic() - started:.1f} s"], error=str(e))
    changed = {k: "changed" if k in state else "added" for k in made}
    return Result("completed", made, changed, [f"{key} made {', '.join(made)} in {time.monotonic() - started:.1f} s"])


def described(spark: SparkSession) -> DataFrame:
    """(key, effect, needs, makes, parameter, kind, default, required) of every parameter; one row for operators without any."""
    rows = []
    for op in recipes.OPERATORS.values():
        own = params_of(op) or [Param("", "", None, False)]
        rows += [(op.key, effect_of(op), list(op.needs), list(op.makes), p.name or None, p.kind or None, None if p.default is None else json.dumps(p.default), p.required) for p in own]
    return spark.createDataFrame(rows, "key string, effect string, needs array<string>, makes array<string>, parameter string, kind string, default string, required boolean")


def discovered(package: str = "tessera.plans") -> list[str]:
    """The modules of a package, all of them imported: operators register as they are."""
    found = importlib.import_module(package)
    return [importlib.import_module(f"{package}.{m.name}").__name__ for m in pkgutil.iter_modules(found.__path__)]


def faults() -> list[str]:
    """What is wrong with the registry: parameters that functions lack or add, tables that none makes, recipes of unknown steps
    or parameters."""
    out = []
    made = {m for o in recipes.OPERATORS.values() for m in o.makes}
    given = {"counts", "obs", "points", "values", "pairs", "weights", "bulk", "samples", "vectors"}
    for op in recipes.OPERATORS.values():
        own = list(inspect.signature(op.run).parameters)[1:]
        if sorted(own) != sorted(op.params):
            out.append(f"{op.key} takes {own}, not {list(op.params)}")
        out += [f"{op.key} needs {n}, which nothing makes" for n in op.needs if n not in made | given]
    for r in recipes.RECIPES.values():
        sample = {k: [1] if v is recipes.REQUIRED else v for k, v in r.params.items()}
        try:
            recipes.steps_of(r, sample)
        except ValueError as e:
            out.append(f"{r.key}: {e}")
    return out


# Recipes as text, staged runs, history.


def to_json(r: recipes.Recipe) -> str:
    params = {k: {"required": True} if v is recipes.REQUIRED else {"default": v} for k, v in r.params.items()}
    return json.dumps({"key": r.key, "params": params, "steps": [{"operator": k, "params": p} for k, p in r.steps]}, indent=1)


def from_json(text: str) -> recipes.Recipe:
    """A recipe from its text; unknown operators, and texts of another form, are an error."""
    try:
        raw = json.loads(text)
        params = {k: recipes.REQUIRED if v.get("required") else v.get("default") for k, v in raw.get("params", {}).items()}
        steps = tuple((s["operator"], dict(s.get("params", {}))) for s in raw["steps"])
        key = raw["key"]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"this is no recipe: {e}") from None
    unknown = [k for k, _ in steps if k not in recipes.OPERATORS]
    if unknown:
        raise ValueError(f"{key}: no operator {', '.join(unknown)}")
    return recipes.Recipe(key, params, steps)


JOB = "seq bigint, session string, function string, params string, status string"


def staged(spark: SparkSession, r: recipes.Recipe, session: str, given: dict[str, Any] | None = None, first: int = 1) -> DataFrame:
    """The steps of a recipe as staged jobs, with their bound parameters as JSON."""
    rows = [(first + k, session, op.key, json.dumps(p, sort_keys=True), "staged") for k, (op, p) in enumerate(recipes.steps_of(r, given))]
    return spark.createDataFrame(rows, JOB)


def edited(jobs: DataFrame, seq: int, params: dict[str, Any]) -> DataFrame:
    """jobs with other parameters for one that is still staged; any other is an error, as are parameters it does not have."""
    row = jobs.where(F.col("seq") == seq).first()
    if row is None or row["status"] != "staged":
        raise ValueError(f"job {seq} is not staged")
    bound = typed(recipes.OPERATORS[row["function"]], {**json.loads(row["params"]), **params})
    return jobs.withColumn("params", F.when(F.col("seq") == seq, json.dumps(bound, sort_keys=True)).otherwise(F.col("params")))


def run_staged(jobs: DataFrame, state: recipes.State) -> tuple[DataFrame, recipes.State]:
    """(jobs with their ends, state): staged jobs one after the other; after a failure the rest stays staged."""
    state = dict(state)
    for row in jobs.where("status = 'staged'").orderBy("seq").collect():  # the steps a user staged
        result = call(row["function"], state, json.loads(row["params"]))
        for to in ("queued", "running", result.status):
            jobs = catalog.moved(jobs, row["seq"], to)
        if result.status == "failed":
            break
        state |= result.frames
    return jobs, state


def recipe_of_history(history: DataFrame, key: str) -> recipes.Recipe:
    """The completed jobs of a history as a recipe without parameters."""
    steps = [(r["function"], json.loads(r["params"])) for r in catalog.steps_of(history).collect()]  # what a user ran
    return recipes.Recipe(key, {}, tuple(steps))
