"""tamisol.functions"""
