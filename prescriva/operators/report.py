"""Recommendation tables, their summaries and sentences: expressions over prescription rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prescriva.functions import numeric, text
from prescriva.operators import quantiles

UNCHANGED = 0.005


def recommendations(df: DataFrame, key: str, actions: list[str], units: dict[str, tuple[float, float]], levels: dict[str, float], before: str, after: str, goal_level: str) -> DataFrame:
    """For each action its value now, recommended and the change in its own unit; activations and levels before, after and wanted; success."""
    columns = []
    for a in actions:
        low, high = units[a]
        now, new = F.col(a) * (high - low) + low, F.col(f"{a}_new") * (high - low) + low
        columns += [F.round(now, 1).alias(f"{a}_now"), F.round(new, 1).alias(f"{a}_recommended"), F.round(new - now, 1).alias(f"{a}_change")]
    level = lambda c: numeric.nearest_level(F.col(c), levels)
    return df.select(key, *columns, F.round(before, 4).alias("activation_before"), F.round(after, 4).alias("activation_after"), level(before).alias("level_before"), level(after).alias("level_after"), F.col(goal_level).alias("level_goal"), numeric.reaches(level(after), F.col(goal_level), levels).alias("success"))


def action_summary(df: DataFrame, actions: list[str]) -> DataFrame:
    """(action, now, recommended, median_change of changed rows, up, down, same), shares in percent; actions in [0, 1]."""
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.col(a).alias("now"), F.col(f"{a}_new").alias("new")) for a in actions))
    long = df.select(F.explode(rows).alias("r")).select("r.*").withColumn("d", F.col("new") - F.col("now"))
    moved = F.abs("d") >= UNCHANGED
    share = lambda c: (F.avg(c.cast("double")) * 100)
    shares = long.groupBy("action").agg(F.avg("now").alias("now"), F.avg("new").alias("recommended"), share(moved & (F.col("d") > 0)).alias("up"), share(moved & (F.col("d") < 0)).alias("down"), share(~moved).alias("same"))
    changes = df.select(*(F.when(F.abs(F.col(f"{a}_new") - F.col(a)) >= UNCHANGED, F.col(f"{a}_new") - F.col(a)).alias(a) for a in actions))
    medians = df.sparkSession.createDataFrame(list(quantiles.medians(changes, actions).items()), "action string, median_change double")
    return shares.join(F.broadcast(medians), "action", "left").select("action", "now", "recommended", "median_change", "up", "down", "same")  # a row for each action


def level_summary(df: DataFrame, level: str, before: str, after: str, success: str) -> DataFrame:
    return df.groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col(success).cast("double")) * 100).alias("success"), F.avg(before).alias("before"), F.avg(after).alias("after"))


def top_gains(df: DataFrame, key: str, before: str, after: str, most: int = 5) -> DataFrame:
    return df.select(key, before, after, (F.col(after) - F.col(before)).alias("gain")).orderBy(F.desc(F.round("gain", 9)), key).limit(most)


@dataclass(frozen=True)
class Action:
    """An action as reports show it: ``low`` and ``high`` in its own unit, ``categories`` of an ordered one."""

    column: str
    name: str
    low: float = 0.0
    high: float = 1.0
    categories: tuple[str, ...] = ()

    def shown(self, value: Column) -> Column:
        """A value in the action's own unit, or its category in quotes."""
        if self.categories:
            return F.concat(F.lit("«"), F.get(F.array(*map(F.lit, self.categories)), F.round(value).cast("int")), F.lit("»"))
        return text.number(value, text.decimals_of(self.low, self.high))


def action_phrase(a: Action, now: Column, new: Column) -> Column:
    """(verb, words, changes): what to do with an action; a verb that several actions may share is apart from the words."""
    # Fixed text.
    share = (new - now) / ((a.high - a.low) or 1.0)
    before, after = a.shown(now), a.shown(new)
    if len(a.categories) == 2:
        on, stays = F.round(now) > 0, F.round(now) == F.round(new)
        verb = F.when(stays, F.when(on, "mantener activa").otherwise("no activar")).otherwise(F.when(on, "desactivar").otherwise("activar"))
        return F.struct(verb.alias("verb"), F.lit(a.name).alias("words"), (~stays).alias("changes"))
    stays = (F.abs(share) < UNCHANGED) | ((before == after) if a.categories else F.lit(False))
    kept = F.concat(F.lit(f"mantener {a.name} en "), before)
    if a.categories:
        moved = F.concat(F.lit(f"pasar {a.name} de "), before, F.lit(" a "), after)
    else:
        size = F.concat(F.when(share > 0, "+").otherwise("−"), text.number(F.abs(new - now), text.decimals_of(a.low, a.high)), F.lit("; "), text.percent(100 * F.abs(share), 0), F.lit(" de su rango"))
        moved = F.concat(F.when(share > 0, "aumentar").otherwise("reducir"), F.lit(f" {a.name} de "), before, F.lit(" a "), after, F.lit(" ("), size, F.lit(")"))
    return F.struct(F.lit(None).cast("string").alias("verb"), F.when(stays, kept).otherwise(moved).alias("words"), (~stays).alias("changes"))


def grouped(phrases: Column) -> Column:
    """Texts of an array of phrases; those with one verb are said together where the first of them stands."""
    verbs = F.transform(phrases, lambda p: p.verb)
    firsts = F.filter(phrases, lambda p, i: p.verb.isNull() | (F.array_position(verbs, p.verb) == i + 1))

    def said(p: Column) -> Column:
        same = F.transform(F.filter(phrases, lambda q: q.verb == p.verb), lambda q: q.words)
        return F.when(p.verb.isNull(), p.words).otherwise(F.concat(p.verb, F.lit(" "), text.listed(same)))

    return F.transform(firsts, said)


def individual_reports(plans: DataFrame, key: str, actions: list[Action], objective: str, levels: dict[str, float], tolerance: float, subject: str = "este perfil") -> DataFrame:
    """(key, report, plan, restriction, changes, keeps, result, brakes, reaches) of each row of ``plans``.

    ``plans`` has <action>_now and <action>_new in their own units, ``base``,
    ``activation``, ``goal`` and ``goal_level``; and where it has them, ``observed`` (a
    level), ``contributions`` (name, role, after) and ``restriction`` (a sentence). A goal
    is reached from ``tolerance`` below it on.
    """
    # Fixed text.
    level = lambda c: numeric.nearest_level(F.col(c), levels)
    own = plans.withColumns({"_phrases": F.array(*(action_phrase(a, F.col(f"{a.column}_now"), F.col(f"{a.column}_new")) for a in actions)), "_before": level("base"), "_after": level("activation")})
    own = own.withColumns({"_changes": grouped(F.filter("_phrases", lambda p: p.changes)), "_keeps": grouped(F.filter("_phrases", lambda p: ~p.changes)), "_kept": F.size(F.filter("_phrases", lambda p: ~p.changes))})
    there = lambda c: F.col(c) >= F.col("goal") - tolerance - 1e-9
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    to_subject = f"al {subject[3:]}" if subject.startswith("el ") else f"a {subject}"
    plan = F.when(F.size("_changes") > 0, join(f"Para {subject} se recomienda ", text.listed(F.col("_changes")), "."))
    fits = join(f"Con sus acciones actuales, el FCM ya ubica {to_subject} en ", F.col("_before"), ", en su meta (", F.col("goal_level"), ") o por encima: según el modelo no hace falta cambiarlas.")
    if "observed" in plans.columns:
        doubt = join(" Su nivel observado es ", F.col("observed"), ": el modelo no lo distingue de ", F.col("_before"), ", así que para él no hay nada que mejorar; tome el plan con cautela o elija una meta más alta.")
        fits = F.concat(fits, F.coalesce(F.when(F.col("observed") != F.col("_before"), doubt), F.lit("")))
    none = F.lit(f"Para {subject} el algoritmo genético no encontró un cambio en las acciones cuyo avance hacia la meta compense el esfuerzo.")
    plan = F.coalesce(plan, F.when(there("base"), fits), none)
    besides = join(" Además, ", text.listed(F.col("_keeps")), ": el modelo no espera un beneficio que compense el esfuerzo de cambiarla", F.when(F.col("_kept") > 1, "s").otherwise(""), ".")
    plan = F.concat(plan, F.when((F.size("_keeps") > 0) & (F.size("_changes") > 0), besides).otherwise(""))
    ends = F.when(there("activation"), join(" y alcanza la meta (", F.col("goal_level"), ").")).otherwise(join(", sin alcanzar la meta (", F.col("goal_level"), "): es el mayor avance que el modelo encuentra con estas acciones."))
    result = join(f"Con este plan, el FCM estima que {objective} pasa de ", text.number(F.col("base"), 2), " (", F.col("_before"), ") a ", text.number(F.col("activation"), 2), " (", F.col("_after"), ")", ends)
    brakes = F.lit("")
    if "contributions" in plans.columns:
        against = F.array_sort(F.transform(F.filter("contributions", lambda c: (c.role == "mutable") & (c.after < -0.05)), lambda c: F.struct(c.after.alias("after"), c["name"].alias("name"))))
        told = F.transform(F.slice(against, 1, 3), lambda c: join(c["name"], " (aporte ", text.number(c.after, 2), ")"))
        brakes = F.when(F.size(told) > 0, join("Factores del sistema que lo alejan del mejor nivel y que el plan no cambia: ", text.listed(told), ".")).otherwise("")
    restriction = F.coalesce("restriction", F.lit("")) if "restriction" in plans.columns else F.lit("")
    sentence = lambda c: F.transform(c, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000), F.lit(".")))
    out = own.select(key, plan.alias("plan"), restriction.alias("restriction"), sentence("_changes").alias("changes"), sentence("_keeps").alias("keeps"), result.alias("result"), brakes.alias("brakes"), there("activation").alias("reaches"))
    parts = F.filter(F.array("plan", "restriction", "result", "brakes"), lambda t: t != "")
    return out.withColumn("report", F.array_join(parts, " "))


def large_changes(table: DataFrame, key: str, actions: list[str], limit: float = 0.3) -> DataFrame:
    """(key, action, change) of changes of more than ``limit`` of the range."""
    rows = F.array(*(F.struct(F.lit(a).alias("action"), (F.col(f"{a}_new") - F.col(a)).alias("change")) for a in actions))
    return table.select(key, F.explode(rows).alias("r")).select(key, "r.*").where(F.abs("change") > limit)


def shown(value: float, decimals: int = 1) -> str:
    """``text.number`` of a driver-side value."""
    out = f"{value:,.{decimals}f}".translate(str.maketrans(",.", ".,"))
    out = out.rstrip("0").rstrip(",") if decimals else out
    return "0" if out == "-0" else out


def _said(parts: list[str]) -> str:
    return "".join(parts) if len(parts) < 2 else f"{', '.join(parts[:-1])} y {parts[-1]}"


def population(plans: DataFrame, key: str, actions: list[Action], levels: dict[str, float], observed: str, objective: str, level: str | None = None, subjects: str = "registros", feminine: bool = False, confirmed: tuple[float, float] | None = None) -> dict:
    """What all plans have in common: figures by action and by observed level, the largest gains, and a text.

    ``plans``: <action>_now and <action>_new in their own units, ``base``, ``activation``,
    ``goal_level`` and ``observed``. ``level``: only rows of that observed level.
    ``confirmed``: shares that an independent model puts at their goals, before and after.
    All figures are aggregations; the driver holds a row for each action and level.
    """
    # Fixed text.
    own = plans if level is None else plans.where(F.col(observed) == level)
    the = "las" if feminine else "los"
    marked = own.withColumn("_end", numeric.reaches(numeric.nearest_level(F.col("activation"), levels), F.col("goal_level"), levels)).withColumn("_start", numeric.reaches(numeric.nearest_level(F.col("base"), levels), F.col("goal_level"), levels))
    by_level = [r.asDict() for r in marked.groupBy(F.col(observed).alias("level"), F.col("goal_level").alias("goal")).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col("_end").cast("double"))).alias("success"), F.avg("base").alias("before"), F.avg("activation").alias("after")).collect()]
    by_level.sort(key=lambda r: (levels.get(r["level"], 0.0), r["goal"]))
    n = sum(r["n"] for r in by_level)
    if not n:
        return {"n": 0, "text": f"No hay {subjects} {'prescritas' if feminine else 'prescritos'} con ese filtro.", "actions": [], "levels": [], "gains": []}
    scaled = marked.select(*((F.col(f"{a.column}_{k}") / ((a.high - a.low) or 1.0)).alias(a.column + ("" if k == "now" else "_new")) for a in actions for k in ("now", "new")))
    found = {r.action: r for r in action_summary(scaled, [a.column for a in actions]).collect()}
    rows = []
    for a in actions:
        r, width = found[a.column], (a.high - a.low) or 1.0
        rows.append({"column": a.column, "name": a.name, "now": r.now * width, "recommended": r.recommended * width, "median_change": (r.median_change or 0.0) * width, "up": r.up, "down": r.down, "same": r.same})
    total = marked.agg((100 * F.avg(F.col("_end").cast("double"))).alias("success"), (100 * F.avg(F.col("_start").cast("double"))).alias("success_before"), F.avg("base").alias("before"), F.avg("activation").alias("after")).first()
    best = max(levels, key=levels.get)
    steps = [f"de «{r['level']}» a «{r['goal']}»" for r in by_level if r["level"] != r["goal"]]
    stepped = any(r["goal"] != best for r in by_level)
    aim = f"su nivel meta, el siguiente al observado ({_said(steps)})," if stepped else f"el mejor nivel («{best}»)"
    parts = [
        f"El algoritmo genético prescribió acciones a {shown(n, 0)} {subjects} de prueba con nivel {' o '.join(dict.fromkeys(f'«{r["level"]}»' for r in by_level))}. "
        f"Con las acciones prescritas, el FCM ubica en {aim} al {shown(total.success)} %; {objective} pasa en promedio de {shown(total.before, 2)} a {shown(total.after, 2)}."
    ]
    if confirmed and level is None:
        parts.append(f"Con sus acciones actuales lo logra el {shown(total.success_before)} %. Un bosque aleatorio independiente confirma {'la meta' if stepped else 'el mejor nivel'} para el {shown(confirmed[1])} % (antes {shown(confirmed[0])} %): es la cifra prudente.")
    binary = {a.column for a in actions if len(a.categories) == 2}
    ranked = sorted(rows, key=lambda r: -r["up"])
    switched = [f"{r['name']} al {shown(r['up'], 0)} %" for r in ranked if r["column"] in binary and r["up"] > 0]
    if switched:
        parts.append(f"Se prescribe activar {_said(switched)} de {the} {subjects}.")
    elif binary:
        parts.append(f"El algoritmo genético no activa ninguna de {_said([a.name for a in actions if a.column in binary])}.")
    decimals = {a.column: text.decimals_of(a.low, a.high) for a in actions}
    often = [f"aumentar {r['name']} (al {shown(r['up'], 0)} % de {the} {subjects}; de {shown(r['now'], decimals[r['column']])} a {shown(r['recommended'], decimals[r['column']])} en promedio)" for r in ranked if r["column"] not in binary and r["up"] >= 50]
    same = [r["name"] for r in rows if r["column"] not in binary and r["same"] >= 50]
    if often:
        parts.append(f"La recomendación más frecuente es {_said(often)}.")
    if same:
        parts.append(f"{_said(same)} se mantiene{'n' if len(same) > 1 else ''} igual en la mayoría de los casos.")
    if len(by_level) > 1:
        parts.append("Por nivel observado: " + "; ".join(f"«{r['level']}» ({shown(r['n'], 0)} {subjects}) llega a «{r['goal']}» el {shown(r['success'])} %" for r in by_level) + ".")
    gains = [r.asDict() for r in top_gains(own, key, "base", "activation").collect()]
    return {"n": n, "success": total.success, "before": total.before, "after": total.after, "actions": rows, "levels": by_level, "gains": gains, "text": " ".join(parts)}


def metric_lines(metrics: dict) -> list[str]:
    """A run's figures as lines for a console."""
    percent = lambda v: "-" if v is None else f"{shown(100 * v)} %"
    out = [f"rows: {metrics['train_rows']} to train on, {metrics['test_rows']} to test"]
    if metrics.get("selection"):
        best = metrics["selection"][0]
        out.append(f"chosen: slope {best['slope']:g}, alpha {best['alpha']:g}; accuracy {percent(best['accuracy'])} in the folds")
    out.append(f"accuracy {percent(metrics['accuracy'])} (largest level {percent(metrics['majority'])}), balanced {percent(metrics['balanced_accuracy'])}, macro F1 {percent(metrics['macro_f1'])}; {metrics['iterations']} steps{'' if metrics['converged'] else ', not all converged'}")
    out += [f"  {r['level']}: precision {percent(r['precision'])}, recall {percent(r['recall'])}, F1 {percent(r['f1'])}, {r['support']} rows" for r in metrics["levels"]]
    out += [f"  error of {r['concept']}: {r['mae']:.4f} mean, {r['rmse']:.4f} root mean square" for r in metrics["concepts"]]
    if metrics.get("prescribed"):
        out.append(f"prescribed: {metrics['prescribed']}; success {shown(metrics['success_before'])} % before, {shown(metrics['success_after'])} % after; mean error {metrics['mae_before']:.4f} and {metrics['mae_after']:.4f}; {shown(metrics['generations'])} generations")
    out += [f"  {r['segment']}: {r['n']} rows, {shown(r['before'])} % before, {shown(r['after'])} % after" for r in metrics.get("segments", [])]
    if metrics.get("forest"):
        out.append(f"confirmed by the forest: {shown(metrics['forest']['confirmed_before'])} % before, {shown(metrics['forest']['confirmed_after'])} % after")
    return out
