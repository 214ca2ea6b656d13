"""DataFrame operators: knowledge base, index, retrieval, answers, evaluation and catalogue."""
