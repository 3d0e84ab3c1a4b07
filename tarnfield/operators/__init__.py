"""DataFrame operators: chunking, search, evaluation, answers, storage, statistics."""
