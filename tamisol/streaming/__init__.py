"""tamisol.streaming"""
