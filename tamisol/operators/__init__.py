"""tamisol.operators"""
