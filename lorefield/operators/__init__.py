"""lorefield.operators"""
