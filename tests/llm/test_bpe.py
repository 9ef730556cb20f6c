import hashlib

import numpy as np
from tokenizers import Tokenizer

from simplexa.llm import bpe
from simplexa.llm.queries import tokenizer_path


def test_against_library(spark):
    texts = ["", None, " \n\t", "Hello, WORLD's 123 naïve café ΣΑΣ", "a<|endoftext|>b", "x" * 3000, "日本語 テスト 🙂🙂", "it's we'll don't", "Á é", "foo\x1cbar baz"]
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in bpe.encode_digests(df, tokenizer_path()).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, texts[r.doc_id]
