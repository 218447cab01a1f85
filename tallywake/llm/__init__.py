"""Training-data operators: tokens, near copies, packing, search, quality, shards and licences."""
