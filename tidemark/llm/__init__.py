"""Training-data operators: tokenizing, media storage, scoring, packing, de-duplication, scanning, chat.

Nothing outside this package imports it.  ``queries`` holds the registered
queries; every other module is one operator with its own general interface.
"""
