"""Training-data operators: near copies, language, mixing, passages, pages, tokens, vectors, archives, chats, search."""
