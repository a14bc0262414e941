"""Column selection, row windows and schema inference over a grid."""
