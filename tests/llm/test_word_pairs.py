from foldline.llm.quality import features


def test_order_of_words_counts():
    one, two = (set(features(t)[0].tolist()) for t in ("red fox sees dogs", "dogs sees fox red"))
    assert one != two and len(one - two) == 3
