"""Timetable feeds: stop-to-stop edges, calendars, next departures, and their export as tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartalog.functions.strings import filter_words
from cartalog.functions.times import WEEKDAYS
from cartalog.operators.query import dense_ids


def stop_edges(stop_times: DataFrame) -> DataFrame:
    """(trip_id, pos, stop, next_stop, seconds): consecutive stops of each trip, from departure to the next arrival, in seconds."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    rows = stop_times.select("trip_id", F.col("stop_sequence").alias("pos"), F.col("stop_id").alias("stop"), F.lead("stop_id").over(w).alias("next_stop"), (F.lead("arrival").over(w) - F.col("departure")).alias("seconds"))
    return rows.where("next_stop is not null")


def trips_per_edge(edges: DataFrame) -> DataFrame:
    """(stop, next_stop, trips): the trips that go from a stop to the next, sorted, repeats kept."""
    return edges.groupBy("stop", "next_stop").agg(F.array_sort(F.collect_list("trip_id")).alias("trips"))


def last_stop_times(stop_times: DataFrame) -> DataFrame:
    """(trip_id, stop_id, stop_sequence, arrival, departure): of several calls at one stop the last."""
    best = stop_times.groupBy("trip_id", "stop_id").agg(F.max(F.struct("stop_sequence", "arrival", "departure")).alias("t"))
    return best.select("trip_id", "stop_id", "t.*")


def is_active(day: Column) -> Column:
    """Whether a calendar row's service runs on a day."""
    flag = F.element_at(F.array(*[F.col(d) for d in WEEKDAYS]), F.weekday(day) + 1)
    return (flag == 1) & day.between(F.col("start_date"), F.col("end_date"))


def next_service(calendar: DataFrame, day: Column) -> DataFrame:
    """(service_id, next_date): the next day on which each service runs, from a day on and within a week.

    Before the service's start it is counted from the start; past its end there is none; without any weekday it is the start.
    """
    first = F.greatest(day, F.col("start_date"))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.date_add(first, k))
    flags = F.array(*[F.col(d) for d in WEEKDAYS])
    running = F.filter(days, lambda d: (F.element_at(flags, F.weekday(d) + 1) == 1) & (d <= F.col("end_date")))
    none = F.forall(flags, lambda f: f != 1)
    return calendar.select("service_id", F.when(day > F.col("end_date"), F.lit(None).cast("date")).when(none, F.col("start_date")).otherwise(F.array_min(running)).alias("next_date"))


def next_departure(stop_times: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, trip_id, wait): the next trip that leaves a stop for the next one, on the day or the one after.

    requests: (request, stop, next_stop, at), at in seconds of the day. Calls and requests of a pair of stops go by once, from the end of the day
    to its start: the earliest call passed so far is a request's next one, the day's earliest that of the day after. No call meets a request.
    """
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    calls = stop_times.select("trip_id", F.col("stop_id").alias("stop"), "departure", F.lead("stop_id").over(w).alias("next_stop")).where("next_stop is not null")
    moment = F.struct(F.pmod("departure", F.lit(86400)).alias("second"), F.col("trip_id").alias("trip_id"))
    both = calls.select("stop", "next_stop", moment.alias("call"), F.lit(None).cast(requests.schema["request"].dataType).alias("request"), F.pmod("departure", F.lit(86400)).alias("second"))
    asked = requests.select("stop", "next_stop", F.lit(None).cast(both.schema["call"].dataType).alias("call"), "request", F.pmod("at", F.lit(86400)).alias("second"))
    pair = Window.partitionBy("stop", "next_stop")
    passed = pair.orderBy(F.desc("second"), F.col("call").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.unionByName(asked).withColumn("later", F.min("call").over(passed)).withColumn("first", F.min("call").over(pair))
    wait = F.pmod(F.coalesce("later.second", "first.second") - F.col("second"), F.lit(86400))
    found = seen.where("request is not null and first is not null").select("request", F.coalesce("later", "first")["trip_id"].alias("trip_id"), wait.alias("wait"))
    # A request stated for several pairs of stops has the least wait.
    return found.groupBy("request").agg(F.min(F.struct("wait", "trip_id")).alias("b")).select("request", "b.trip_id", "b.wait")


def to_tags(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(objectid, tag, value): a row per filled column of each record."""
    pairs = F.array(*[F.struct(F.lit(c).alias("tag"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(key).alias("objectid"), F.inline(pairs)).where("value is not null and value <> ''")


def name_words(df: DataFrame, key: str, name: str) -> DataFrame:
    """(objectid, tag, value): name0, name1 .. for names of several words, without punctuation."""
    parts = filter_words(F.split(F.col(name), "\\s+"))
    rows = df.select(F.col(key).alias("objectid"), parts.alias("parts")).where("size(parts) > 1")
    return rows.select("objectid", F.posexplode("parts").alias("k", "value")).select("objectid", F.concat(F.lit("name"), F.col("k").cast("string")).alias("tag"), "value")


def group_rows(stop_times: DataFrame) -> DataFrame:
    """(groupid, objectid, objectorder): trips as groups of their stop times."""
    return stop_times.select(F.col("trip_id").alias("groupid"), F.col("stop_time_id").alias("objectid"), F.col("stop_sequence").alias("objectorder"))


def bus_relations(relations: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Feed tables from bus relations (relid, type, route, ref, name, operator, network) and their members (relid, pos, type, ref).

    A relation counts if it names an operator or network and a ref, and has a member that is a node; the first of each ref does.
    """
    stops = members.where("type = 'node'")
    named = relations.where("type = 'route' and route = 'bus' and ref is not null and ref <> '' and coalesce(nullif(operator, ''), nullif(network, '')) is not null")
    served = named.join(stops.select("relid").distinct(), "relid", "left_semi")
    first = served.groupBy("ref").agg(F.min("relid").alias("relid")).select("relid")
    kept = served.join(first, "relid", "left_semi")
    agency = F.coalesce(F.nullif("operator", F.lit("")), "network")
    agencies = dense_ids(kept.select(agency.alias("agency_name")), "agency_name", "agency_id").withColumn("agency_id", (F.col("agency_id") + 1).cast("int"))
    routes = kept.select(agency.alias("agency_name"), F.col("relid").alias("route_id"), F.col("ref").alias("route_short_name"), F.col("name").alias("route_long_name"), F.lit(3).alias("route_type")).join(agencies, "agency_name").drop("agency_name")
    trips = kept.select(F.col("relid").alias("trip_id"), F.col("relid").alias("route_id"))
    calls = stops.join(kept.select("relid"), "relid", "left_semi").select(F.col("relid").alias("trip_id"), F.col("ref").alias("stop_id"), F.row_number().over(Window.partitionBy("relid").orderBy("pos")).alias("stop_sequence"))
    return {"agency": agencies, "routes": routes, "trips": trips, "stop_times": calls}


def timetable_edges(edges: DataFrame) -> DataFrame:
    """(startid, endid, cost): the least seconds between consecutive stops, for searches over the timetable's graph."""
    return edges.where("seconds >= 0").groupBy(F.col("stop").alias("startid"), F.col("next_stop").alias("endid")).agg(F.min("seconds").alias("cost"))
