"""lorefield.streaming"""
