"""Compositions of operators: text stage, feature stage, training, evaluation."""
