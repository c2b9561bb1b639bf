"""DataFrame-to-DataFrame operators over timelines.

Operators take the names of their key columns.  Sequential decisions (thinning,
matching, packing of cues) are cut at places where the decision cannot depend
on what came before, and folded within these islands only, so one key may hold
many rows.
"""
