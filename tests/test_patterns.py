"""Patterns from words."""

import pytest
from pyspark.sql import functions as F

from geosift.functions import patterns as P


@pytest.fixture(scope="module")
def found(spark):
    def run(pattern, text):
        return spark.createDataFrame([(text,)], "t string").select(F.regexp_extract("t", pattern, 0)).first()[0]

    return run


@pytest.mark.parametrize("words,text,want", [
    (("завод=",), "о заводе", "заводе"), (("завод=",), "заводской", ""), (("служб*",), "службами", "службами"), (("по ремонту",), "по \n ремонту", "по \n ремонту"),
    (("г.",), "гг", ""), (("цех",), "цехом", ""), (("цех",), "Ёцех", ""), (("цех",), "ЦЕХ-2", "ЦЕХ"),
])
def test_words(found, words, text, want):
    assert found(rf"{P.I}(?<!\w){P.one_of(words, P.BODY_ENDINGS)}(?!\w)", text) == want


@pytest.mark.parametrize("text,want", [
    ("в г. Ивано-Франк, 5", "г. Ивано-Франк"), ("аг.Марьина Горка", "аг.Марьина Горка"), ("г. 5", ""), ("д. 12", "д. 12"), ("г. Минск-", "г. Минск"), ("дог. Минск", ""), ("п. а", ""), ("г. один два три четыре", "г. один два три"),
])
def test_named_places(found, text, want):
    assert found(P.LOCALITY, text) == want


@pytest.mark.parametrize("text,want", [
    ("линия 375", ""), ("цех 1375", ""), ("цех 375 29 563-38-19", "375 29 563-38-19"), ("+ 375", "+ 375"), ("8-029", "8-029"), ("( 017 ) 2", "( 017 )"), ("Тел. 2", "Тел"), ("телега", ""), ("факс", "факс"),
])
def test_phone_marks(found, text, want):
    assert found(P.PHONE_MARK, text) == want
