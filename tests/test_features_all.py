def test_all_features_transliterate_like_the_query_of_that_group(spark, tmp_path):
    from kinfold.plans.queries import QUERIES

    address = "one two three four five six seven eight nine ten 11 12 13 14"
    names = ["иван петров завод moskva", "ivan petrov завод moskva", "иван petrov завод moskva"]
    rows = [(i, f"{address} {names[i % 3]}", "en", "s", 1) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["s1_id", "target_idx", "transliterated_name_fuzz", "transliterated_token_jaccard", "transliterated_char_trigram_jaccard"]
    every = sorted(QUERIES["features_all"](spark, str(tmp_path)).select(columns).collect())
    assert every and every == sorted(QUERIES["feat_translit"](spark, str(tmp_path)).select(columns).collect())
    assert all(r["transliterated_token_jaccard"] == 1 for r in every)
