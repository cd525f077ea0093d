"""How words move in the SentencePiece operator."""

from spreadrank.llm import sentencepiece_lattice


def test_words_move_as_numbers(spark):
    """Seldom words are joined by a number of 8 bytes, however long they are."""
    model = sentencepiece_lattice.Model([("▁", -1.0, 3), ("a", -2.0, 4)], None, 0)
    words = sentencepiece_lattice.words_of(spark.createDataFrame([(" a aa",)], "text string"))
    table = sentencepiece_lattice.encode_words(words, model)
    assert dict(table.dtypes) == {"key": "bigint", "bytes": "int", "n": "bigint", "ids": "array<int>"}
    assert sorted(r.ids for r in table.collect()) == [[3, 4], [3, 4, 4]]
