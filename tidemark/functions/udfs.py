"""User functions: column expressions first, and the registered UDF, UDTF and UDAF surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Cities whose temperatures are shown in Fahrenheit. Fixed values.
FAHRENHEIT_CITIES = ("Chicago", "Portland", "Seattle", "New York")
#: A grid over New York. Bounds, cell sizes in degrees, cells across.
WEST, EAST, SOUTH, NORTH = -74.05, -73.7, 40.5, 41.0
CELL_WIDTH, CELL_HEIGHT, ACROSS = 0.0014, 0.00125, 250


def to_fahr(city: Column, celsius: Column) -> Column:
    """Fahrenheit in the cities that use it, Celsius elsewhere."""
    return F.when(city.isin(*FAHRENHEIT_CITIES), celsius * 9 / 5 + 32).otherwise(celsius)


def in_nyc(lon: Column, lat: Column) -> Column:
    return lon.between(WEST, EAST) & lat.between(SOUTH, NORTH)


def area_id(lon: Column, lat: Column) -> Column:
    """Number of the grid cell: whole cells east of the corner, and ACROSS for each whole cell south of it."""
    east, south = F.floor((lon - WEST) / CELL_WIDTH), F.floor((NORTH - lat) / CELL_HEIGHT)
    return (south * ACROSS + east).cast("int")


def area_coords(cell: Column) -> Column:
    """Centre of a grid cell, as a struct of lon and lat."""
    east, south = F.pmod(cell, F.lit(ACROSS)), F.floor(cell / ACROSS)
    centre = {"lon": WEST + (east + 0.5) * CELL_WIDTH, "lat": NORTH - (south + 0.5) * CELL_HEIGHT}
    return F.struct(*[v.cast("float").alias(k) for k, v in centre.items()])


def add_source(name: str = "NYCTAXI") -> Column:
    return F.lit(name)


def register(spark: SparkSession) -> None:
    """The same functions for SQL: to_fahr, add_source, split_words (a table function) and weighted_mean (an aggregate)."""

    @F.pandas_udf("double")
    def fahr(city: pd.Series, celsius: pd.Series) -> pd.Series:
        return celsius.where(~city.isin(FAHRENHEIT_CITIES), celsius * 9 / 5 + 32)

    @F.udtf(returnType="word string, length int")
    class SplitWords:
        def eval(self, line: str):
            for word in (line or "").split():
                yield word, len(word)

    @F.pandas_udf("double")
    def weighted_mean(value: pd.Series, weight: pd.Series) -> float:
        total = float(weight.sum())
        return float((value * weight).sum() / total) if total else float("nan")

    spark.udf.register("to_fahr", fahr)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION add_source() RETURNS STRING RETURN 'NYCTAXI'")
    spark.udtf.register("split_words", SplitWords)
    spark.udf.register("weighted_mean", weighted_mean)
